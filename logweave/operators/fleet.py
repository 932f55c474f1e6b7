"""Fleet inventory derived from an append-only log of agent messages.

``messages`` follows ``schemas.AGENT_MESSAGE``: an absent field is unchanged.
``seq`` is arrival order over the whole log. Operator actions (pushes, tag
changes, deletes) are tables of their own on the same ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SNAPSHOT
from .joins import join_dimension
from .ordered import CHUNK_ROWS, count_within, latest, running_total, with_previous

# Restart history length, flap window and threshold.
MAX_RESTART_HISTORY = 10
FLAP_WINDOW_SECONDS = 600
FLAP_THRESHOLD = 3

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL for anything else."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(text))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


# --- latest state ---

def inventory(messages: DataFrame, asof: Column | None = None, actions: DataFrame | None = None,
              deletes: DataFrame | None = None) -> DataFrame:
    """One row per agent with the last value of each field.

    ``actions`` (``agent_id, seq, ts``) create a row for an agent that has not
    reported yet but do not move ``last_seen`` of one that has. ``deletes``
    (``agent_id, seq``, with ``asof`` also ``ts``) forget everything up to them.
    ``asof`` cuts all of the logs.
    """
    rows = messages.withColumn("_from_agent", F.lit(True))
    if actions is not None:
        rows = rows.unionByName(actions.select("agent_id", "seq", "ts", F.lit(False).alias("_from_agent")), allowMissingColumns=True)
    if asof is not None:
        rows = rows.filter(F.col("ts") <= asof)
        deletes = deletes if deletes is None else deletes.filter(F.col("ts") <= asof)
    if deletes is not None:
        rows = current_incarnation(rows, deletes)
    always = F.col("_from_agent")
    has = lambda name: F.col(name).isNotNull()
    state = latest(rows, ["agent_id"], "seq", {
        "_description": (F.col("description"), has("description")),
        "_health": (F.col("health"), has("health")),
        "snapshot_json": (F.col("snapshot_json"), has("snapshot_json")),
        "last_started_at": (F.col("started_at"), _text(F.col("started_at")) != ""),
        "effective_config": (F.col("effective_config"), has("effective_config")),
    }, [F.max(F.when(always, F.col("ts"))).alias("_seen"), F.min_by("ts", "seq").alias("_created")])
    return state.withColumn("effective_config_hash", config_hash(F.col("effective_config"))).select(
        "agent_id",
        *[_text(F.col(f"_description.{n}")).alias(n) for n in ("hostname", "service_version", "local_ui_addr")],
        F.date_trunc("second", F.coalesce("_seen", "_created")).alias("last_seen"),
        F.coalesce("_health.healthy", F.lit(True)).alias("healthy"),
        _text(F.col("_health.last_error")).alias("last_error"),
        *[_text(F.col(n)).alias(n) for n in ("snapshot_json", "last_started_at", "effective_config_hash")],
    )


def current_incarnation(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows after each agent's last delete."""
    last = deletes.groupBy("agent_id").agg(F.max("seq").alias("_deleted"))
    return join_dimension(rows, last, ["agent_id"], "left").filter(
        F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))).drop("_deleted")


def incarnations(messages: DataFrame, deletes: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Lives of each agent: messages between two deletes, numbered from 0."""
    both = messages.select("agent_id", "seq", "ts", F.lit(0).alias("_delete")).unionByName(
        deletes.select("agent_id", "seq", F.lit(1).alias("_delete")), allowMissingColumns=True)
    numbered = running_total(both, ["agent_id"], "seq", F.col("_delete"), "incarnation", span)
    return numbered.filter(F.col("_delete") == 0).groupBy("agent_id", "incarnation").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("messages"))


def list_agents(inventory_: DataFrame) -> DataFrame:
    return inventory_.orderBy("hostname", "agent_id")


def get_agent(inventory_: DataFrame, agent_id: str) -> DataFrame:
    return inventory_.filter(F.col("agent_id") == agent_id)


def staleness(inventory_: DataFrame, asof: Column) -> DataFrame:
    """Add ``stale_seconds`` since last_seen, never negative."""
    age = F.round((F.unix_micros(asof) - F.unix_micros("last_seen")) / 1e6).cast("bigint")
    return inventory_.withColumn("stale_seconds", F.greatest(F.lit(0).cast("bigint"), age))


# --- restarts ---

def with_started_at(messages: DataFrame) -> DataFrame:
    """Messages whose start time, where it is not given, is that of their snapshot."""
    given = F.nullif(F.col("started_at"), F.lit("")) if "started_at" in messages.columns else F.lit(None).cast("string")
    return messages.withColumn("started_at", F.coalesce(given, F.nullif(F.get_json_object("snapshot_json", "$.started_at"), F.lit(""))))


def restarts(messages: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Reports whose start time differs from the report before; an agent's
    first report is its baseline."""
    reports = messages.filter(_text(F.col("started_at")) != "").select("agent_id", "seq", "ts", "started_at")
    return with_previous(reports, ["agent_id"], "seq", ["started_at"], span,
                         keep=lambda prev: prev["started_at"] != F.col("started_at")).drop("_prev")


def restart_history(restarts_: DataFrame, n: int = MAX_RESTART_HISTORY) -> DataFrame:
    """Last ``n`` restart times per agent, oldest first. The row limit is
    applied before the shuffle, so no agent brings more than n per partition."""
    last = Window.partitionBy("agent_id").orderBy(F.desc("seq"))
    kept = restarts_.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n)
    return kept.groupBy("agent_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "started_at"))), lambda r: r["started_at"]).alias("restart_history"))


def flapping(history: DataFrame, asof: Column, window_seconds: int = FLAP_WINDOW_SECONDS, threshold: int = FLAP_THRESHOLD) -> DataFrame:
    """Add the number of retained restarts strictly after ``asof - window`` and
    whether that makes the agent flapping."""
    cutoff = F.timestamp_micros(F.unix_micros(asof) - window_seconds * 1_000_000)
    recent = F.filter("restart_history", lambda t: F.coalesce(rfc3339(t) > F.col("_cutoff"), F.lit(False)))
    return history.withColumn("_cutoff", cutoff).withColumn("restart_count_recent", F.size(recent)).withColumn(
        "flapping", F.col("restart_count_recent") >= threshold).drop("_cutoff")


def flap_episodes(restarts_: DataFrame, window_seconds: int = FLAP_WINDOW_SECONDS, threshold: int = FLAP_THRESHOLD) -> DataFrame:
    """The flapping rule evaluated at each restart, over the start times."""
    at = restarts_.withColumn("_at", F.unix_micros(rfc3339(F.col("started_at")))).filter("_at is not null")
    counted = count_within(at, ["agent_id"], "_at", window_seconds * 1_000_000, "recent")
    return counted.withColumn("flapping", F.col("recent") >= threshold).drop("_at")


# --- configuration ---

def config_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def config_changes(reports: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Effective-config reports that an agent would send: the first, and each
    whose hash differs from the report before."""
    hashed = reports.filter(F.col("effective_config").isNotNull()).select(
        "agent_id", "seq", "ts", config_hash(F.col("effective_config")).alias("hash"))
    return with_previous(hashed, ["agent_id"], "seq", ["hash"], span,
                         keep=lambda prev: prev.isNull() | (prev["hash"] != F.col("hash"))).drop("_prev")


def config_drift(state: DataFrame) -> DataFrame:
    """Add ``config_drifted``: the running config is neither the last known
    good one nor the pending one, once one was ever pushed."""
    good, running, pending = (_text(F.col(c)) for c in ("last_known_good_hash", "effective_config_hash", "pending_config_hash"))
    return state.withColumn("config_drifted", (good != "") & (running != "") & (running != good) & (running != pending))


def _rollout(pushes: DataFrame, outcomes: DataFrame, payload: list[str], span: int) -> DataFrame:
    """Fold pushes and outcomes into pending, last known good and error.

    The pending push at any outcome is the event right before it, if that is a
    push. So one look at the previous event decides each outcome, and the rest
    are latest-by aggregates that combine map-side.
    """
    events = pushes.select("agent_id", "seq", F.lit("push").alias("event"), F.struct(*payload).alias("payload")).unionByName(
        outcomes.select("agent_id", "seq", "event", "error"), allowMissingColumns=True)
    seen = with_previous(events, ["agent_id"], "seq", ["event", "payload"], span)
    promoted = (F.col("event") == "applied") & F.coalesce(F.col("_prev.event") == "push", F.lit(False))
    failed = F.col("event") == "failed"
    push = F.col("event") == "push"
    state = latest(seen, ["agent_id"], "seq", {
        "good": (F.col("_prev.payload"), promoted),
        "error": (F.when(failed, _text(F.col("error"))).otherwise(""), promoted | failed),
        "pushed": (F.col("payload"), push),
        "push_seq": (F.col("seq"), push),
        "outcome_seq": (F.col("seq"), ~push),
    }, [F.min_by("event", "seq").alias("first_event")])
    open_ = F.col("push_seq") > F.coalesce("outcome_seq", F.lit(-(2**63)))
    return state.withColumn("pending", F.when(open_, F.col("pushed")))


def _outcomes(messages: DataFrame, column: str, applied: str, failed: str) -> DataFrame:
    status = F.lower(F.col(f"{column}.status"))
    event = F.when(status == applied.lower(), "applied").when(status == failed.lower(), "failed")
    return messages.select("agent_id", "seq", event.alias("event"), F.col(f"{column}.error").alias("error")).filter("event is not null")


def config_rollout(messages: DataFrame, pushes: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Config push state per agent; ``pushes`` is ``(agent_id, seq, content)``.

    APPLIED makes the pending config the last known good one and clears the
    error; with nothing pending it is ignored. FAILED drops the pending config
    and keeps the error.
    """
    hashed = pushes.withColumn("hash", config_hash(F.col("content")))
    state = _rollout(hashed, _outcomes(messages, "config_status", "APPLIED", "FAILED"), ["content", "hash"], span)
    return state.select(
        "agent_id",
        _text(F.col("pending.content")).alias("pending_config"), _text(F.col("pending.hash")).alias("pending_config_hash"),
        _text(F.col("good.content")).alias("last_known_good_config"), _text(F.col("good.hash")).alias("last_known_good_hash"),
        _text(F.col("error")).alias("last_config_error"))


def package_rollout(messages: DataFrame, pushes: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Package push state per agent; ``pushes`` is ``(agent_id, seq, name,
    version, hash)``. One slot per agent."""
    names = ["name", "version", "hash"]
    state = _rollout(pushes, _outcomes(messages, "package_status", "Installed", "InstallFailed"), names, span)
    pick = lambda struct, prefix: [_text(F.col(f"{struct}.{n}")).alias(f"{prefix}_package_{n}") for n in names]
    return state.select("agent_id", *pick("pending", "pending"), *pick("good", "last_known_good"),
                        _text(F.col("error")).alias("last_package_error"))


def rollback_plan(state: DataFrame, kind: str = "config") -> DataFrame:
    """Agents that can be rolled back and what to send them again."""
    if kind == "config":
        return state.filter(F.col("last_known_good_config") != "").select(
            "agent_id", F.col("last_known_good_config").alias("content"), config_hash(F.col("last_known_good_config")).alias("hash"))
    if kind == "package":
        return state.filter(F.col("last_known_good_package_version") != "").select(
            "agent_id", *[F.col(f"last_known_good_package_{n}").alias(n) for n in ("name", "version", "hash")])
    raise ValueError(f"kind must be config or package, not {kind!r}")


# --- packages ---

def packages(uploads: DataFrame) -> DataFrame:
    """Catalogue: the last upload of each (name, version)."""
    last = uploads.groupBy("name", "version").agg(F.max_by(F.struct("hash", "uploaded_at"), "seq").alias("_u"))
    return last.select("name", "version", "_u.hash", "_u.uploaded_at")


def list_packages(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy("name", F.desc("uploaded_at"))


def get_package(catalogue: DataFrame, name: str, version: str) -> DataFrame:
    return catalogue.filter((F.col("name") == name) & (F.col("version") == version))


# --- tags and bulk pushes ---

def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_tags(df: DataFrame, column: str = "tags") -> DataFrame:
    """Trim, lowercase, drop empty and repeated tags (first one stays). A comma
    in any tag rejects the request: ``rejected`` names it, tags become NULL."""
    clean = F.filter(F.transform(column, lambda t: F.lower(_trimmed(t))), lambda t: t != "")
    bad = F.get(F.filter(clean, lambda t: t.contains(",")), F.lit(0))
    return df.withColumn("rejected", bad).withColumn(column, F.when(F.col("rejected").isNull(), F.array_distinct(clean)))


def tags_latest(tag_events: DataFrame) -> DataFrame:
    """Tags per agent: the last accepted write replaces the whole set."""
    return tag_events.filter(F.col("tags").isNotNull()).groupBy("agent_id").agg(F.max_by("tags", "seq").alias("tags"))


def parse_csv_list(csv: Column) -> Column:
    return F.filter(F.split(_text(csv), ","), lambda x: x != "")


def by_tag(inventory_: DataFrame, tag: str) -> DataFrame:
    """Agents that carry exactly ``tag``."""
    return inventory_.filter(F.array_contains("tags", tag))


def bulk_plan(inventory_: DataFrame, tag: str, connected: DataFrame) -> DataFrame:
    """What a push to all agents with ``tag`` would report per agent."""
    matched = by_tag(inventory_, tag).select("agent_id", "hostname")
    here = connected.select("agent_id").distinct().withColumn("_here", F.lit(True))
    total = matched.agg(F.count("*").alias("n"))
    return matched.join(here, "agent_id", "left").select(
        "agent_id", "hostname",
        F.when(F.col("_here"), "sent").otherwise("pending").alias("status"),
        F.when(F.col("_here"), "").otherwise("agent not connected").alias("error"),
        total.scalar().alias("matched"))


def validate_config_pushes(pushes: DataFrame) -> DataFrame:
    """Add ``rejected``: why a config push is refused, NULL if it is fine."""
    return pushes.withColumn("rejected", F.when(_trimmed(_text(F.col("content"))) == "", "config must not be empty"))


def validate_package_pushes(pushes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``rejected`` and the catalogue's ``hash`` to package pushes."""
    known = catalogue.select("name", "version", "hash")
    blank = (_text(F.col("name")) == "") | (_text(F.col("version")) == "")
    return join_dimension(pushes, known, ["name", "version"], "left").withColumn(
        "rejected", F.when(blank, "name and version must not be empty").when(F.col("hash").isNull(), "unknown package version"))


# --- totals ---

def snapshot_counters(inventory_: DataFrame) -> DataFrame:
    """Long counters ``(agent_id, section, component, field, value)`` of every
    agent's last snapshot."""
    snap = inventory_.filter(F.col("snapshot_json") != "").select("agent_id", F.from_json("snapshot_json", SNAPSHOT).alias("s"))

    def section(name: str, fields: list[str]) -> Column:
        return F.transform(F.coalesce(F.map_entries(f"s.{name}"), F.array()), lambda e: F.struct(
            F.lit(name).alias("section"), e["key"].alias("component"),
            F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(e["value"][f], F.lit(0).cast("bigint")).alias("value")) for f in fields]).alias("counters")))

    rows = F.concat(
        section("receivers", ["events_in"]),
        section("pipelines", ["events_in", "events_out", "events_dropped", "events_dead_lettered", "parse_errors"]),
        section("exporters", ["events_in", "batches_sent", "batches_failed", "retries"]))
    components = snap.select("agent_id", F.inline(rows))
    return components.select("agent_id", "section", "component", F.inline("counters"))


def exporter_errors(inventory_: DataFrame) -> DataFrame:
    """``(agent_id, component, last_error, last_error_at)`` of the exporters whose
    last snapshot tells an error."""
    snap = inventory_.filter(F.col("snapshot_json") != "").select("agent_id", F.from_json("snapshot_json", SNAPSHOT).alias("s"))
    each = snap.select("agent_id", F.explode("s.exporters").alias("component", "_e")).filter("_e.last_error is not null")
    return each.select("agent_id", "component", F.col("_e.last_error.message").alias("last_error"), F.col("_e.last_error.at").alias("last_error_at"))


def agent_breakdown(inventory_: DataFrame) -> DataFrame:
    """All components of each agent's last snapshot, one row each: the counters
    its section has (else NULL), the exporter's last error and whether it is in
    trouble (dropped events, parse errors or failed batches)."""
    fields = ["events_in", "events_out", "events_dropped", "events_dead_lettered", "parse_errors", "batches_sent", "batches_failed", "retries"]
    snap = inventory_.filter(F.col("snapshot_json") != "").select("agent_id", F.from_json("snapshot_json", SNAPSHOT).alias("s"))

    def section(name: str) -> Column:
        own = {f.name for f in SNAPSHOT[name].dataType.valueType.fields}
        number = lambda v, n: F.coalesce(v[n], F.lit(0).cast("bigint")) if n in own else F.lit(None).cast("bigint")
        error = lambda v: v["last_error"]["message"] if "last_error" in own else F.lit(None).cast("string")
        return F.transform(F.coalesce(F.map_entries(f"s.{name}"), F.array()), lambda e: F.struct(
            F.lit(name).alias("section"), e["key"].alias("component"), *[number(e["value"], n).alias(n) for n in fields], error(e["value"]).alias("last_error")))

    rows = snap.select("agent_id", F.inline(F.concat(section("receivers"), section("pipelines"), section("exporters"))))
    some = lambda n: F.coalesce(F.col(n) > 0, F.lit(False))
    return rows.withColumn("problem", some("events_dropped") | some("parse_errors") | some("batches_failed"))


def fleet_total(counters: DataFrame, section: str, field: str) -> DataFrame:
    wanted = (F.col("section") == section) & (F.col("field") == field)
    return counters.filter(wanted).agg(F.coalesce(F.sum("value"), F.lit(0).cast("bigint")).alias("total"))


def agent_states(messages: DataFrame, pushes: DataFrame, asof: Column, span: int = CHUNK_ROWS,
                 window_seconds: int = FLAP_WINDOW_SECONDS, threshold: int = FLAP_THRESHOLD) -> DataFrame:
    """Inventory, flapping and config rollout of every agent that has sent a message, out of one pass.

    The log and the pushes ``(agent_id, seq, content)`` are one table in the order of ``seq``. A
    window inside each chunk of it tells every row the start time and the push or outcome
    before it; what is before the chunk comes out of one row per chunk. All else are
    aggregates of one grouping. Same as ``inventory``, ``flapping`` and ``config_rollout``.
    """
    keys = ["agent_id", "_chunk"]
    push = pushes.select("agent_id", "seq", F.struct("content", config_hash(F.col("content")).alias("hash")).alias("_push"))
    status = F.lower(F.col("config_status.status"))
    kind = F.when(F.col("_push").isNotNull(), "push").when(status == "applied", "applied").when(status == "failed", "failed")
    rows = messages.withColumn("_sent", F.lit(True)).unionByName(push, allowMissingColumns=True).withColumns({
        "_chunk": F.expr(f"seq div {int(span)}"), "_started": F.nullif(F.col("started_at"), F.lit("")), "_event": F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("_push").alias("push")))})
    inside = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_before": F.last(c, True).over(inside) for c in ("_started", "_event")})

    # The last of each chunk, with what the chunk's last row has itself, then the last of the chunks before.
    own = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))) for c in ("_started", "_event")}
    across = Window.partitionBy("agent_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys).agg(*[v.alias(c) for c, v in own.items()]).select(*keys, *[F.last(c, True).over(across).alias(f"{c}_carry") for c in own])
    rows = rows.join(carry, keys).withColumns({f"{c}_before": F.coalesce(f"{c}_before", f"{c}_carry") for c in own})

    restarted = F.coalesce(F.col("_started") != F.col("_started_before"), F.lit(False))
    rows = rows.withColumn("_restart", restarted)
    # No chunk brings more than the last ten.
    late = F.row_number().over(Window.partitionBy(*keys, "_restart").orderBy(F.desc("seq"))) <= MAX_RESTART_HISTORY
    rows = rows.withColumn("_late", F.when(F.col("_restart") & late, F.struct("seq", F.col("_started").alias("at"))))
    has = lambda name: F.col(name).isNotNull()
    applied = (F.col("_event.kind") == "applied") & F.coalesce(F.col("_event_before.kind") == "push", F.lit(False))
    failed, pushed = F.col("_event.kind") == "failed", has("_push")
    state = latest(rows, ["agent_id"], "seq", {
        "_description": (F.col("description"), has("description")), "_health": (F.col("health"), has("health")), "snapshot_json": (F.col("snapshot_json"), has("snapshot_json")),
        "last_started_at": (F.col("_started"), has("_started")), "effective_config": (F.col("effective_config"), has("effective_config")),
        "_good": (F.col("_event_before.push"), applied), "_error": (F.when(failed, _text(F.col("config_status.error"))).otherwise(""), applied | failed),
        "_pushed": (F.col("_push"), pushed), "_push_seq": (F.col("seq"), pushed), "_outcome_seq": (F.col("seq"), has("_event") & ~pushed),
    }, [F.max(F.when(F.col("_sent"), F.col("ts"))).alias("_seen"), F.count("_sent").alias("_messages"), F.collect_list("_late").alias("_late")]).where("_messages > 0")
    history = F.slice(F.sort_array("_late", asc=False), 1, MAX_RESTART_HISTORY)
    cutoff = F.timestamp_micros(F.unix_micros(asof) - window_seconds * 1_000_000)
    recent = F.size(F.filter(history, lambda r: F.coalesce(rfc3339(r["at"]) > F.col("_cutoff"), F.lit(False))))
    open_ = F.col("_push_seq") > F.coalesce("_outcome_seq", F.lit(-(2**63)))
    return state.withColumn("_cutoff", cutoff).select(
        "agent_id", *[_text(F.col(f"_description.{n}")).alias(n) for n in ("hostname", "service_version", "local_ui_addr")],
        F.date_trunc("second", "_seen").alias("last_seen"), F.coalesce("_health.healthy", F.lit(True)).alias("healthy"), _text(F.col("_health.last_error")).alias("last_error"),
        *[_text(F.col(n)).alias(n) for n in ("snapshot_json", "last_started_at")], _text(config_hash(F.col("effective_config"))).alias("effective_config_hash"),
        F.reverse(F.transform(history, lambda r: r["at"])).alias("restart_history"), recent.alias("restart_count_recent"), (recent >= threshold).alias("flapping"),
        *[_text(F.when(open_, F.col(f"_pushed.{n}"))).alias(f"pending_config{suffix}") for n, suffix in (("content", ""), ("hash", "_hash"))],
        _text(F.col("_good.content")).alias("last_known_good_config"), _text(F.col("_good.hash")).alias("last_known_good_hash"), _text(F.col("_error")).alias("last_config_error"))


def fleet_overview(state: DataFrame) -> DataFrame:
    """One row for the fleet. ``state`` has healthy, flapping, config_drifted and
    snapshot_json, whose counters are added up inside its row first."""
    zero = F.lit(0).cast("bigint")

    def total(section: str, field: str) -> Column:
        values = F.coalesce(F.map_values(f"_s.{section}"), F.array().cast(T.ArrayType(SNAPSHOT[section].dataType.valueType)))
        return F.coalesce(F.aggregate(values, zero, lambda sum_, v: sum_ + F.coalesce(v[field], zero)), zero)

    sums = {"events_in": ("receivers", "events_in"), "events_dropped": ("pipelines", "events_dropped"), "parse_errors": ("pipelines", "parse_errors"), "batches_failed": ("exporters", "batches_failed")}
    each = state.withColumn("_s", F.from_json(F.nullif(F.col("snapshot_json"), F.lit("")), SNAPSHOT))
    each = each.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("healthy", "flapping", "config_drifted")], *[total(*of).alias(n) for n, of in sums.items()])
    return each.agg(
        F.count("*").alias("agents"), F.count_if("healthy").alias("healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"), F.count_if("flapping").alias("flapping"),
        F.count_if("config_drifted").alias("config_drift"), *[F.coalesce(F.sum(n), zero).alias(n) for n in sums])


def agent_stats(inventory_: DataFrame) -> DataFrame:
    """Process usage per agent: cpu seconds, memory and heap in MiB (one decimal)."""
    snap = inventory_.filter(F.col("snapshot_json") != "").select("agent_id", F.from_json("snapshot_json", SNAPSHOT).alias("s"))
    mib = lambda c: F.round(F.col(f"s.process.{c}") / 1048576, 1)
    return snap.select("agent_id", F.round("s.process.cpu_seconds", 1).alias("cpu_seconds"),
                       mib("memory_rss_bytes").alias("rss_mib"), mib("heap_alloc_bytes").alias("heap_mib"))


def health_timeline(messages: DataFrame, span: int = CHUNK_ROWS) -> DataFrame:
    """Unhealthy spells: from a failing report to the next good one (NULL while
    it lasts), with the first error text."""
    reports = messages.filter(F.col("health").isNotNull()).select(
        "agent_id", "seq", "ts", F.col("health.healthy").alias("healthy"), _text(F.col("health.last_error")).alias("error"))
    changes = with_previous(reports, ["agent_id"], "seq", ["healthy"], span,
                            keep=lambda prev: prev.isNull() | (prev["healthy"] != F.col("healthy"))).drop("_prev")
    spells = with_previous(changes, ["agent_id"], "seq", ["seq", "ts"], span, following=True)
    return spells.filter(~F.col("healthy")).select(
        "agent_id", F.col("seq").alias("start_seq"), F.col("ts").alias("start_ts"),
        F.col("_prev.seq").alias("end_seq"), F.col("_prev.ts").alias("end_ts"), "error")


# --- stored state ---

def align_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Bring stored rows of an older shape to ``target``: missing columns are
    added, text that was never set reads as ''. Running it twice changes nothing."""
    cols = []
    for field in target.fields:
        old = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = old.cast(field.dataType)
        cols.append((_text(value) if isinstance(field.dataType, T.StringType) else value).alias(field.name))
    return df.select(*cols)
