"""Live fleet state: each micro-batch is summarised with the batch operators
and merged with the last state of the agents in it.

A keyed state operator would send all rows of a chatty agent to one task. Here
a batch is first reduced to one row per agent, and only those rows meet the
state. A batch writes the new rows of its agents alone (see ``runs``): silent
agents cost nothing, and a batch that runs again, after a lost executor or a
restart, gives the same table. The folder must be one that every executor reaches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import fleet as f
from ..operators import metrics as m
from ..operators.ordered import latest
from ..schemas import AGENT_STATE
from ..session import remove
from ..sources.scrapes import read_metric_scrapes
from .delivery import trigger_args
from .runs import Runs, added_up, newest_by

_PUSHES = {"config": ["content", "hash"], "package": ["name", "version", "hash"]}


def living(rows: DataFrame) -> DataFrame:
    """Rows after the last delete of their agent, without the deletes."""
    return f.current_incarnation(rows.filter("deleted is null or not deleted"), rows.filter("deleted").select("agent_id", "seq"))


def summarise(rows: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """One row per agent for a stretch of the message log.

    ``rows`` is the message shape plus the operator actions ``config_push``
    (struct content), ``package_push`` (struct name, version, hash) and
    ``deleted`` (boolean), NULL where a row is something else. ``alive`` is ``living(rows)``,
    which is read six times: a caller with many rows hands it over persisted.
    """
    gone = rows.filter("deleted").groupBy("agent_id").agg(F.lit(True).alias("reset"))
    alive = living(rows) if alive is None else alive
    has = lambda name: F.col(name).isNotNull()
    from_agent = F.col("config_push").isNull() & F.col("package_push").isNull()
    started = F.coalesce("started_at", F.lit("")) != ""
    base = latest(alive, ["agent_id"], "seq", {
        "description": (F.col("description"), has("description")),
        "health": (F.col("health"), has("health")),
        "snapshot_json": (F.col("snapshot_json"), has("snapshot_json")),
        "effective_config": (F.col("effective_config"), has("effective_config")),
        "last_started_at": (F.col("started_at"), started),
    }, [
        F.count("*").alias("messages"), F.max(F.when(from_agent, F.col("ts"))).alias("seen"), F.min_by("ts", "seq").alias("created"),
        F.min_by(F.when(started, F.col("started_at")), F.when(started, F.col("seq"))).alias("first_started_at"),
    ])
    history = f.restart_history(f.restarts(alive))
    pushes = alive.filter(has("config_push")).select("agent_id", "seq", "config_push.content").withColumn(
        "hash", f.config_hash(F.col("content")))
    packages = alive.filter(has("package_push")).select("agent_id", "seq", "package_push.*")
    config = f._rollout(pushes, f._outcomes(alive, "config_status", "APPLIED", "FAILED"), _PUSHES["config"], f.CHUNK_ROWS)
    package = f._rollout(packages, f._outcomes(alive, "package_status", "Installed", "InstallFailed"), _PUSHES["package"], f.CHUNK_ROWS)
    part = lambda df, name: df.select("agent_id", *[F.col(c).alias(f"{name}_{c}") for c in ("good", "error", "pending", "first_event")])
    return (base.join(history, "agent_id", "left").join(part(config, "config"), "agent_id", "left")
            .join(part(package, "package"), "agent_id", "left").join(gone, "agent_id", "full"))


STATE = tuple(n for n in AGENT_STATE.names if n not in ("agent_id", "gone", "batch"))


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch summary, of the agents in the batch. One row per agent on both sides."""
    joined = batch.select("agent_id", *[F.col(c).alias(f"b_{c}") for c in batch.columns if c != "agent_id"]).join(
        state.select("agent_id", F.lit(True).alias("known"), *STATE), "agent_id", "left")
    # A delete in the batch forgets the old state; without a later message the agent is gone.
    reset = F.coalesce("b_reset", F.lit(False))
    gone = F.col("b_messages").isNull() & (reset | F.col("known").isNull())
    joined = joined.withColumn("gone", gone).withColumns({c: F.when(~reset, F.col(c)) for c in STATE})
    none = F.array().cast("array<string>")
    crossed = (F.coalesce("last_started_at", F.lit("")) != "") & (F.col("b_first_started_at") != F.col("last_started_at"))
    restarts = F.concat(F.coalesce("restart_history", none), F.when(crossed, F.array("b_first_started_at")).otherwise(none), F.coalesce("b_restart_history", none))
    keep = F.lit(f.MAX_RESTART_HISTORY)

    def rollout(kind: str) -> list[Column]:
        first, pending = F.col(f"b_{kind}_first_event"), F.col(f"{kind}_pending")
        promoted = (first == "applied") & pending.isNotNull()
        return [
            F.when(first.isNotNull(), F.col(f"b_{kind}_pending")).otherwise(pending).alias(f"{kind}_pending"),
            F.coalesce(F.col(f"b_{kind}_good"), F.when(promoted, pending), F.col(f"{kind}_good")).alias(f"{kind}_good"),
            F.coalesce(F.col(f"b_{kind}_error"), F.when(promoted, ""), F.col(f"{kind}_error")).alias(f"{kind}_error"),
        ]

    latest_of = lambda name: F.coalesce(F.col(f"b_{name}"), F.col(name)).alias(name)
    return joined.select(
        "agent_id", latest_of("description"), latest_of("health"), latest_of("snapshot_json"),
        F.coalesce(f.config_hash(F.col("b_effective_config")), F.col("effective_config_hash")).alias("effective_config_hash"),
        F.coalesce("b_seen", "last_seen", "b_created").alias("last_seen"), latest_of("last_started_at"),
        F.slice(restarts, F.greatest(F.lit(1), F.size(restarts) - keep + 1), keep).alias("restart_history"),
        *rollout("config"), *rollout("package"), "gone")


def state_runs(out: str, **options) -> Runs:
    return Runs(out, AGENT_STATE, newest_by("agent_id", "batch", "gone"), bucket_by="agent_id", **options)


def fleet_state_stream(rows: DataFrame, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Maintain the state of every agent under ``out``. A batch reads the buckets of
    its agents and writes one row for each of them. See ``current_state``;
    ``options`` (``fan``, ``buckets``) must stay the same for a folder."""
    runs = state_runs(out, **options)

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs.begin(spark, batch_id)
        batch = batch.persist()
        # Whole messages meet the deletes once; without that each part of the summary would join, and shuffle, them again.
        alive = living(batch).persist()
        summary = summarise(batch, alive).persist()
        touched = [r[0] for r in summary.select(runs.bucket()).distinct().collect()]
        old = runs.before(spark, batch_id, touched).join(summary.select("agent_id"), "agent_id", "left_semi")
        runs.write(merge(runs.combine(old, True), summary).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)
        for kept in (summary, alive, batch):
            kept.unpersist()

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger_args(every)).start()


def current_state(spark: SparkSession, out: str, **options) -> DataFrame:
    """The newest state of every agent, in the shape of the batch inventory and rollouts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    state = state_runs(out, **options).newest(spark)
    return state.select(
        "agent_id", *[text(F.col(f"description.{n}")).alias(n) for n in ("hostname", "service_version", "local_ui_addr")],
        F.date_trunc("second", "last_seen").alias("last_seen"), F.coalesce("health.healthy", F.lit(True)).alias("healthy"),
        text(F.col("health.last_error")).alias("last_error"),
        *[text(F.col(n)).alias(n) for n in ("snapshot_json", "last_started_at", "effective_config_hash")],
        F.coalesce("restart_history", F.array().cast("array<string>")).alias("restart_history"),
        text(F.col("config_pending.content")).alias("pending_config"), text(F.col("config_pending.hash")).alias("pending_config_hash"),
        text(F.col("config_good.content")).alias("last_known_good_config"), text(F.col("config_good.hash")).alias("last_known_good_hash"),
        text(F.col("config_error")).alias("last_config_error"),
        *[text(F.col(f"package_pending.{n}")).alias(f"pending_package_{n}") for n in _PUSHES["package"]],
        *[text(F.col(f"package_good.{n}")).alias(f"last_known_good_package_{n}") for n in _PUSHES["package"]],
        text(F.col("package_error")).alias("last_package_error"))


#: Seconds after which a scrape that is not complete has failed.
SCRAPE_TIMEOUT = 60


def report_runs(out: str, scrape_type: str = "bigint", **options) -> Runs:
    """One row per agent: health as of its newest scrape, counters as of its newest good one."""
    shape = T.StructType.fromDDL(f"agent_id string, scrape_id {scrape_type}, healthy boolean, last_error string, good_scrape_id {scrape_type}, snapshot_json string")

    def combine(rows: DataFrame, whole: bool) -> DataFrame:
        newest = F.max_by(F.struct("scrape_id", "healthy", "last_error"), "scrape_id")
        good = F.max_by(F.struct("good_scrape_id", "snapshot_json"), "good_scrape_id")
        return rows.groupBy("agent_id").agg(newest.alias("_health"), good.alias("_counters")).select("agent_id", "_health.*", "_counters.*")

    return Runs(f"{out}/reports", shape, combine, bucket_by="agent_id", **options)


def report_stream(lines: DataFrame, routes: DataFrame, receivers: DataFrame, exporters: DataFrame, out: str, checkpoint: str,
                  every: str | None = "15 seconds", timeout: float = SCRAPE_TIMEOUT, **options) -> StreamingQuery:
    """The newest report of each agent, as soon as all lines of its scrape are there.

    ``lines`` is ``(agent_id, scrape_id, lines, line_no, text, error, started_at,
    scraped_at)``: ``lines`` says how many rows the scrape has, ``scrape_id``
    grows within an agent. A failed scrape is one row with ``error``. The rows of
    scrapes that are not complete wait in a table versioned by batch. One that is not
    complete ``timeout`` seconds after its first line arrived has failed: the agent is
    unhealthy, and the lines are dropped. That is looked at when a batch comes; lines that
    come after it wait as a scrape of their own, and fail again. An agent is reported
    from its first scrape that is complete or has failed. Of the good scrapes that a batch
    completes for an agent, the newest replaces the others: only of that one the samples are
    read and a document is made, so a batch makes at most one for each agent. ``routes``,
    ``receivers`` and ``exporters`` are as in ``metrics.snapshot``. See ``current_reports``.
    """
    by = ["agent_id", "scrape_id"]
    runs = report_runs(out, lines.schema["scrape_id"].dataType.simpleString(), **options)

    def report(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs.begin(spark, batch_id)
        now = _arrival(spark, f"{out}/arrivals", batch_id)
        rows = batch.withColumn("_arrived", now)
        if batch_id:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out}/open/version={batch_id - 1}"))
        rows = rows.persist()
        counted = rows.groupBy(*by).agg(F.count("*").alias("_here"), F.max("lines").alias("_lines"), F.max("error").alias("error"),
                                        F.max("started_at").alias("started_at"), F.max("scraped_at").alias("scraped_at"), F.min("_arrived").alias("_since"))
        whole = F.coalesce(F.col("_here") >= F.col("_lines"), F.lit(False)) | F.col("error").isNotNull()
        late = ~whole & (F.unix_micros(now) - F.unix_micros("_since") >= int(timeout * 1e6))
        cut = F.concat(F.lit("scrape incomplete: "), F.col("_here").cast("string"), F.lit(" of "), F.coalesce(F.col("_lines").cast("string"), F.lit("?")), F.lit(" lines"))
        counted = counted.withColumn("_done", whole | late).withColumn("error", F.when(late, cut).otherwise(F.col("error"))).persist()
        done = counted.where("_done").select(*by, "error", "started_at", "scraped_at")
        # Combined before the shuffle: a row per agent, however many scrapes it has in the batch.
        newest = F.max_by(F.struct("scrape_id", "started_at", "scraped_at"), "scrape_id")
        good = done.where("error is null").groupBy("agent_id").agg(newest.alias("_newest")).select("agent_id", "_newest.*").persist()
        samples = read_metric_scrapes(rows.join(good.select(*by), by, "left_semi").select(*by, "line_no", "text")).persist()
        graphs = [df.join(good.select(*by), "agent_id").persist() for df in (routes, receivers, exporters)]
        documents = m.status_documents(good, samples, *graphs, by)
        fresh = done.select(*by, F.col("error").isNull().alias("healthy"), F.coalesce("error", F.lit("")).alias("last_error"),
                            F.when(F.col("error").isNull(), F.col("scrape_id")).alias("good_scrape_id")).join(documents, by, "left")
        rows.join(counted.where("not _done").select(*by), by, "left_semi").write.mode("overwrite").parquet(f"{out}/open/version={batch_id}")
        runs.write(runs.combine(fresh, False), batch_id)
        for old in ("open/version", "arrivals/batch"):
            remove(spark, f"{out}/{old}={batch_id - 2}")
        for kept in (*graphs, samples, good, counted, rows):
            kept.unpersist()

    return lines.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(**trigger_args(every)).start()


def _arrival(spark: SparkSession, folder: str, batch_id: int) -> Column:
    """When a batch came first. It is kept, so that a batch that runs again has the same time."""
    path = f"{folder}/batch={batch_id}"
    kept = spark.read.schema("at bigint")
    try:
        at = kept.parquet(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        at = None
    if at is None:
        spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("at")).coalesce(1).write.mode("overwrite").parquet(path)
        at = kept.parquet(path).first()
    return F.timestamp_micros(F.lit(at["at"]))


def current_reports(spark: SparkSession, out: str, scrape_type: str = "bigint", **options) -> DataFrame:
    """The newest report of each agent replaces the ones before: ``(agent_id,
    healthy, last_error, snapshot_json)``. Health follows the newest scrape; a
    failed one leaves the last counters as they are."""
    return report_runs(out, scrape_type, **options).newest(spark).select("agent_id", "healthy", "last_error", "snapshot_json")


def _flap_runs(out: str) -> Runs:
    return Runs(out, T.StructType.fromDDL("agent_id string, minute timestamp, restarts bigint"), added_up(["agent_id", "minute"], ["restarts"]))


def flap_stream(restarts: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Count restarts per agent and minute in the order of arrival, so that none
    is too late to count. A batch that is run again replaces its counts.

    ``restarts`` is a stream of ``(agent_id, restarted_at)``; without a time a
    restart is in no window. See ``flap_counts``.
    """
    runs = _flap_runs(out)

    def count(batch: DataFrame, batch_id: int) -> None:
        runs.begin(batch.sparkSession, batch_id)
        runs.write(batch.filter("restarted_at is not null").groupBy("agent_id", F.date_trunc("minute", "restarted_at").alias("minute")).agg(
            F.count("*").alias("restarts")), batch_id)

    return restarts.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(**trigger_args(every)).start()


def flap_counts(spark: SparkSession, out: str) -> DataFrame:
    """What ``flap_stream`` has counted so far: ``(agent_id, minute, restarts)``."""
    return _flap_runs(out).newest(spark)


def flap_windows(counts: DataFrame, threshold: int = f.FLAP_THRESHOLD) -> DataFrame:
    """Agents with at least ``threshold`` restarts in ten minutes that begin at
    ``window_start``, from ``flap_counts``."""
    back = F.explode(F.sequence(F.lit(0), F.lit(f.FLAP_WINDOW_SECONDS - 60), F.lit(60)))
    each = counts.select("agent_id", "restarts", "minute", back.alias("_back"))
    start = F.timestamp_seconds(F.unix_seconds("minute") - F.col("_back"))
    return each.groupBy("agent_id", start.alias("window_start")).agg(F.sum("restarts").alias("restarts")).filter(F.col("restarts") >= threshold)
