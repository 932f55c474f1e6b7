"""Source, sink and streaming queries. Streams run to the end of their input
and return what they wrote, so the batch SQL is their oracle too."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from ..functions import maps
from ..operators import fleet as f
from ..operators import logs
from ..operators.chain import Chain, regex_parse
from ..operators.joins import estimated_bytes
from ..operators.templates import LINE_PATTERNS, normalize
from ..session import newest_version, shared_dir, shuffles_dropped
from ..sinks.envelopes import to_datalake, to_hec
from ..sources.files import read_log_files
from ..sources.frames import read_syslog_frames, split_octet_frames
from ..sources.messages import read_agent_messages
from ..sources.winevents import read_windows_events
from ..streaming import delivery as d
from ..streaming import fleet as live
from . import fleet_state as fs
from .fleet_state import DUCK, messages
from .lines import lines_sql, template_sql
from .log_search import EVENT_KEYS, EVENTS, _recent, labelled, records
from .registry import query, run_sql, table
from .volume import SAMPLES, SCRAPES, STATUS_AT, one_pipeline, shown_status, status_sql

US = fs._US["spark"]


def _timed(spark, sf):
    """Event records with their timestamp."""
    times = run_sql(spark, sf, f"select event_id as seq, {US} as ts, concat('syslog/r', user_id % 5) as receiver from {{events}}")
    return records(spark, sf, EVENTS, EVENT_KEYS).drop("severity").join(times, "seq")


# --- sources ---

@query("""select event_id as seq, case when event_id % 3 = 0 then 'syslog/udp' else 'syslog/tcp' end as receiver, case when event_id % 3 = 0 then 'udp' else 'tcp' end as transport,
    concat('<', event_id % 200, '>', event_type, ' ', props) as payload, epoch_us(ts)::bigint as received_us from {events}""")
def syslog_frames(spark, sf):
    landed = run_sql(spark, sf, f"select event_id as seq, cast(concat('<', event_id % 200, '>', event_type, ' ', props) as binary) as payload, {US} as received_at from {{events}}")
    own = lambda transport, rows: read_syslog_frames(rows, f"syslog/{transport}", transport)
    frames = own("udp", landed.where("seq % 3 = 0")).unionByName(own("tcp", landed.where("seq % 3 <> 0")))
    return frames.select("seq", "receiver", "transport", "payload", F.unix_micros("received_at").alias("received_us"))


_FRAMES = """select doc_id, text, concat('second 12 é', doc_id) as other, case doc_id % 3 when 0 then '' when 1 then '77 cut off' else 'no length' end as tail from {documents}"""


@query(f"""select doc_id, 0 as frame_no, text as message, nullif(tail, '') as leftover from ({_FRAMES})
    union all select doc_id, 1, other, nullif(tail, '') from ({_FRAMES})""")
def octet_frames(spark, sf):
    """Whole documents as counted frames, with a tail that is none."""
    parts = run_sql(spark, sf, _FRAMES)
    size = lambda c: F.octet_length(c).cast("string")
    payload = F.concat(size("text"), F.lit(" "), "text", size("other"), F.lit(" "), "other", "tail")
    out = split_octet_frames(parts.select("doc_id", payload.alias("payload")))
    return out.select("doc_id", "frame_no", "message", F.col("_leftover").alias("leftover"))


_XML = lines_sql("active_directory")
_EVENT = """regexp_extract(body, '<EventID>([0-9]+)<', 1) as event_id, regexp_extract(body, '<Level>([0-9]+)<', 1) as level,
    regexp_extract(body, '<Computer>([^<]*)<', 1) as computer, regexp_extract(body, 'Provider Name="([^"]*)"', 1) as provider"""


@query(f"""select seq, {_EVENT}, 'windows_security' as sourcetype, 'active_directory' as datasource from ({_XML}) where contains(body, '<Channel>Security<')""")
def ad_events(spark, sf):
    """Windows events of one channel through the directory template."""
    events = read_windows_events(run_sql(spark, sf, _XML).withColumnRenamed("body", "xml"), "Security")
    names = ("event_id", "level", "computer", "provider", "sourcetype", "datasource")
    return normalize(events, "active_directory", {n: f"attributes.{n}" for n in names}, keep=("seq",))


@query(f"""select seq, {_EVENT} from ({_XML}) where contains(body, '<Channel>System<') and cast(regexp_extract(body, '<Level>([0-9]+)<', 1) as integer) >= 3""")
def windows_event_query(spark, sf):
    events = read_windows_events(run_sql(spark, sf, _XML).withColumnRenamed("body", "xml"), "System", "*[System[Level>=3]]")
    return events.select("seq", *[F.col("attributes")[n].alias(n) for n in ("event_id", "level", "computer", "provider")])


@query(f"select event_type as kind, count(*) as lines, sum(length(body))::bigint as chars from ({lines_sql('mysql')}) where event_type not in ('error') group by 1")
def file_lines(spark, sf):
    """Lines written as rotated files, read back by include and exclude globs."""
    root = shared_dir(spark)
    run_sql(spark, sf, lines_sql("mysql")).select("event_type", "body").write.partitionBy("event_type").text(f"{root}/logs")
    lines = read_log_files(spark, [f"{root}/logs/*/part-*", f"{root}/logs/event_type=c*/*"], [f"{root}/logs/event_type=error/*"], "beginning")
    kind = F.regexp_extract("file_path", "event_type=([a-z]+)", 1)
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"), F.sum(F.length("body")).alias("chars"))


@query(f"select body from ({lines_sql('kafka')}) where seq % 3 <> 0")
def tailed_lines(spark, sf):
    """A stream from the end: what was there before it began is left out, what arrives
    while it is stopped is read when it resumes."""
    root = shared_dir(spark)
    lines = run_sql(spark, sf, lines_sql("kafka"))

    def arrive(third: int) -> None:
        lines.where(F.col("seq") % 3 == third).select("body").write.mode("append").text(f"{root}/logs/{third}")

    def tail(started: datetime | None = None) -> None:
        stream = read_log_files(spark, [f"{root}/logs/*/part-*"], stream=True, started=started, checkpoint=f"{root}/cp")
        stream.select("body").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()

    arrive(0)
    # A second from now: files carry times of a second at the least.
    start = datetime.now(timezone.utc) + timedelta(seconds=1)
    time.sleep(2)
    arrive(1)
    tail(start)
    arrive(2)
    tail()
    return spark.read.parquet(f"{root}/out").select("body")


@query(f"""select agent_id, seq, hostname, healthy::integer as healthy, started_at, effective_config, config_status from ({DUCK})""")
def message_log(spark, sf):
    """The message log through its JSON form; absent parts stay absent."""
    root = shared_dir(spark)
    messages(spark, sf).write.json(f"{root}/messages")
    back = read_agent_messages(spark, f"{root}/messages")
    return back.select("agent_id", "seq", F.col("description.hostname").alias("hostname"), F.col("health.healthy").cast("int").alias("healthy"),
                       "started_at", "effective_config", F.col("config_status.status").alias("config_status"))


# --- envelopes ---

@query(f"""select seq, epoch_us(ts)::bigint as time_us, r1 as host, body as event, 'main' as "index", a1 as sourcetype, null::varchar as source, concat('host.name=', r1, ',session_id=', a2) as fields
    from ({EVENTS}) e join (select event_id as seq, ts from {{events}}) t using (seq)""")
def hec_envelope(spark, sf):
    out = to_hec(_timed(spark, sf), index="main", attr_map={"sourcetype": "event_type", "source": ""})
    return out.select("seq", (F.col("time") * 1_000_000).cast("bigint").alias("time_us"), "host", "event", "index", "sourcetype",
                      "source", F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("fields"))


_HOSTED = """select event_id as seq, event_type, case when event_id % 3 = 0 then concat('own-', user_id % 4) when event_id % 3 = 1 then '' end as own,
    case when event_id % 5 = 0 then concat('res-', user_id % 4) end as res, case when event_id % 2 = 0 then concat('name-', user_id % 4) end as name from {events}"""


@query(f"""select seq, coalesce(nullif(own, ''), nullif(res, ''), nullif(name, ''), 'collector-1') as "serverHost", case event_type when 'error' then 'ERROR' else 'UNSPECIFIED' end as severity,
    1 as n_attrs from ({_HOSTED})""")
def datalake_host(spark, sf):
    flat = run_sql(spark, sf, _HOSTED)
    df = flat.select("seq", F.lit(None).cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").alias("severity_text"),
                     F.lit(None).cast("int").alias("severity_number"), F.lit("x").alias("body"),
                     maps.present({"serverHost": F.col("own"), "kind": F.col("event_type")}).alias("attributes"),
                     maps.present({"serverHost": F.col("res"), "host.name": F.col("name")}).alias("resource"))
    out = to_datalake(df, hostname="collector-1")
    return out.select("seq", "serverHost", "severity", F.size("attrs").alias("n_attrs"))


@query(f"select seq, body, a1 as event_type, r1 as host, severity from ({labelled(EVENTS)}) where a1 = 'error'")
def exported_records(spark, sf):
    """The records found, written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/export"
    logs.export_logs(logs.correlate(records(spark, sf, EVENTS, EVENT_KEYS), "event_type", "error"), path)
    back = spark.read.schema("seq long, body string, severity string, attributes map<string,string>, resource map<string,string>").json(path)
    return back.select("seq", "body", F.col("attributes")["event_type"].alias("event_type"), F.col("resource")["host.name"].alias("host"), "severity")


# --- streams ---

def _feed(spark, df, start, order: str = "seq", parts: int = 3) -> str:
    """Parts of a table arrive one after the other; the stream ``start(input,
    out, checkpoint)`` works each off, stops and resumes. Returns the folder."""
    root = shared_dir(spark)
    lo, hi = (x or 0 for x in df.agg(F.min(order), F.max(order)).first())
    step = (hi - lo) // parts + 1
    for i in range(parts):
        df.filter((F.col(order) >= lo + i * step) & (F.col(order) < lo + (i + 1) * step)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2**31 - 1).parquet(f"{root}/in")
        start(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    return f"{root}/out"


@query(_recent(EVENTS).replace("select *", "select seq, severity, body", 1))
def live_recent(spark, sf):
    out = _feed(spark, _timed(spark, sf), d.recent_stream)
    return newest_version(spark, out).select("seq", "severity", "body")


@query(f"select seq, severity, body, a1 as event_type, r1 as host from ({labelled(EVENTS)})")
def live_feed(spark, sf):
    """Flattened records appended batch by batch."""
    out = _feed(spark, _timed(spark, sf), d.recent_sink)
    return spark.read.parquet(out).select("seq", "severity", "body", F.col("attributes")["event_type"].alias("event_type"),
                                                    F.col("resource")["host.name"].alias("host"))


_ROUTES = """select concat('logs/p', n_nationkey) as pipeline, array(concat('syslog/r', n_nationkey % 7), concat('syslog/r', n_nationkey % 2)) as receivers,
    array(concat('splunk_hec/x', n_regionkey), 'dataset/lake', 'debug') as exporters from {nation}"""
_DUCK_ROUTES = _ROUTES.replace("array(", "list_value(")


_ROUTED = f"""select e.*, r.pipeline as route, unnest(r.exporters) as exporter from (
    select l.*, epoch_us(ts)::bigint as us, concat('syslog/r', user_id % 5) as receiver from ({labelled(EVENTS)}) l join (select event_id as seq, ts, user_id from {{events}}) t using (seq)) e
    join (select pipeline, unnest(receivers) as receiver, exporters from ({_DUCK_ROUTES})) r using (receiver)"""


@query(f"""select exporter, route, case when exporter <> 'debug' then r1 end as host, case when exporter <> 'debug' then a1 end as event_type, case when exporter like 'dataset/%' then severity end as severity,
    count(*) as events, count(distinct body) as texts, min(body) as first_text, max(body) as last_text, sum(length(body))::bigint as chars,
    sum(case when exporter like 'splunk%' then us end)::bigint as us from ({_ROUTED}) group by all""")
def live_delivery(spark, sf):
    """Routed to exporters as a stream: every exporter gets the whole output, each in its envelope."""
    routes = run_sql(spark, sf, _ROUTES)
    out = _feed(spark, _timed(spark, sf), lambda stream, out, cp: d.run_pipeline(stream, routes, out, cp))
    # Folder names escape the slash, and file URIs escape the percent sign.
    name = lambda level: F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), level + "=([^/]*)/", 1)))
    written = spark.read.option("recursiveFileLookup", "true").text(out)
    sent = written.select(name("exporter").alias("exporter"), name("pipeline").alias("route"), "value")
    # One part of the folders after the other: a shuffle holds the texts of one part only.
    parts = int(min(MOST_PARTS, 1 + estimated_bytes(written) // PART_BYTES))
    path = f"{shared_dir(spark)}/totals"
    with shuffles_dropped(spark):
        for i in range(parts):
            own = _delivered(sent.where(F.pmod(F.xxhash64("exporter", "route"), F.lit(parts)) == i))
            own.write.mode("append").parquet(path)
    return _long_where_it_fits(spark.read.schema(own.schema).parquet(path), "us")


#: Packed files whose totals are worked out at once, and the number of parts at most.
PART_BYTES, MOST_PARTS = 256 << 20, 64
_ENVELOPE = """time decimal(20,6), host string, serverHost string, event string, message string, severity string,
    fields struct<event_type:string>, attrs struct<event_type:string>"""


def _delivered(sent):
    """Totals of delivered lines; a text counts once in a group however often it came.
    Only texts with their counts are shuffled; what follows from them is worked out after."""
    plain = F.col("exporter") == "debug"
    rows = sent.withColumn("e", F.from_json(F.when(~plain, F.col("value")), _ENVELOPE))
    group = ("exporter", "route", "host", "event_type", "severity")
    texts = rows.select(
        "exporter", "route", F.coalesce("e.host", "e.serverHost").alias("host"), F.coalesce("e.fields.event_type", "e.attrs.event_type").alias("event_type"), "e.severity",
        F.when(plain, F.col("value")).otherwise(F.coalesce("e.event", "e.message")).alias("text"), (F.col("e.time") * 1_000_000).cast("decimal(20,0)").alias("us"))
    each = texts.groupBy(*group, "text").agg(F.count("*").alias("n"), F.sum("us").alias("us"))
    return each.groupBy(*group).agg(
        F.sum("n").alias("events"), F.count("text").alias("texts"), F.min("text").alias("first_text"), F.max("text").alias("last_text"), F.sum(F.length("text") * F.col("n")).alias("chars"),
        F.sum("us").cast("decimal(30,0)").alias("us"))


def _long_where_it_fits(kept, column: str):
    """A stored sum of decimals as a long; where a row's does not fit (the times of some 5,000
    events add up to more), the column stays a decimal, so that no row is lost or cut."""
    fits = kept.where(F.abs(column) > 2**63 - 1).isEmpty()
    return kept.withColumn(column, F.col(column).cast("bigint")) if fits else kept


@query(f"""select receiver, count(*) as events_in, count(*) filter (ok) as events_out, count(*) filter (not ok) as parse_errors
    from ({template_sql('nginx')}) l group by 1""")
def live_quality(spark, sf):
    """Quality counts of all records; one in seven has no time."""
    lines = run_sql(spark, sf, lines_sql("nginx")).join(
        run_sql(spark, sf, f"select event_id as seq, if(event_id % 7 = 0, null, {US}) as ts from {{events}}"), "seq")
    kept = lambda stream: Chain(stream).apply([regex_parse(LINE_PATTERNS["nginx"], on_error="drop")]).records(keep_dropped=True)
    out = d.quality_counts(spark, _feed(spark, lines, lambda stream, out, cp: d.quality_stream(kept(stream), out, cp), parts=10))
    return out.groupBy("receiver").agg(*[F.sum(c).alias(c) for c in ("events_in", "events_out", "parse_errors")])


def _operations(spark, sf):
    """Messages and operator actions in one log. An action follows the message
    of the same event."""
    msgs = messages(spark, sf).withColumn("seq", F.col("seq") * 4)
    times = run_sql(spark, sf, f"select event_id as id, {US} as ts from {{events}}")
    shift = lambda sql, by: run_sql(spark, sf, sql).withColumnRenamed("seq", "id").join(times, "id").withColumn("seq", F.col("id") * 4 + by)
    pushes = shift(fs.PUSHES, 1).select("agent_id", "seq", "ts", F.struct("content").alias("config_push"))
    packages = shift(fs.PACKAGE_PUSHES, 2).select("agent_id", "seq", "ts", F.struct("name", "version", "hash").alias("package_push"))
    deletes = shift(fs.DELETES, 3).select("agent_id", "seq", "ts", F.lit(True).alias("deleted"))
    out = msgs
    for part in (pushes, packages, deletes):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


_ALIVE = lambda sql: f"select p.* from ({sql}) p left join ({fs._LAST_DELETE}) d using (agent_id) where deleted is null or seq > deleted"
_LIVE_RESTARTS = fs._RESTARTS.replace(f"({DUCK})", f"({fs._ALIVE})")
_LIVE_CONFIG = fs.rollout_sql(_ALIVE(fs.PUSHES), fs._CONFIG_OUT.replace(f"({DUCK})", f"({fs._ALIVE})"), "content")
_LIVE_PACKAGE = fs.rollout_sql(_ALIVE(fs.PACKAGE_PUSHES), fs._PACKAGE_OUT.replace(f"({DUCK})", f"({fs._ALIVE})"), "concat(name, ' ', version)")


@query(f"""select i.agent_id, i.hostname, i.last_seen, i.healthy, i.last_error, i.snapshot_json, i.last_started_at, i.effective_config_hash,
    coalesce(h.restart_history, '') as restart_history, coalesce(c.pending, '') as pending_config, coalesce(c.good, '') as last_known_good_config, coalesce(c.error, '') as last_config_error,
    coalesce(p.pending, '') as pending_package, coalesce(p.good, '') as last_known_good_package, coalesce(p.error, '') as last_package_error
    from ({fs._INVENTORY.format(source=fs._ALIVE)}) i
    left join (select agent_id, string_agg(started_at, ',' order by seq) as restart_history from (select *, row_number() over (partition by agent_id order by seq desc) as rn
        from ({_LIVE_RESTARTS})) where rn <= {f.MAX_RESTART_HISTORY} group by 1) h using (agent_id)
    left join ({_LIVE_CONFIG}) c using (agent_id) left join ({_LIVE_PACKAGE}) p using (agent_id)""")
def live_fleet_state(spark, sf):
    """Inventory, restarts and both rollouts kept up to date over micro-batches,
    deletes included; equal to the batch result over the whole log."""
    state = live.current_state(spark, _feed(spark, _operations(spark, sf), live.fleet_state_stream))
    pair = lambda p: F.trim(F.concat_ws(" ", f"{p}_package_name", f"{p}_package_version"))
    return state.select(
        "agent_id", "hostname", F.unix_seconds("last_seen").alias("last_seen"), F.col("healthy").cast("int").alias("healthy"), "last_error",
        "snapshot_json", "last_started_at", "effective_config_hash", F.array_join("restart_history", ",").alias("restart_history"),
        "pending_config", "last_known_good_config", "last_config_error", pair("pending").alias("pending_package"),
        pair("last_known_good").alias("last_known_good_package"), "last_package_error")


@query(f"""with r as (select agent_id, epoch(started_at::timestamptz)::bigint as t from ({fs._RESTARTS})),
    w as (select agent_id, t - t % 60 - k * 60 as window_start from r, (select unnest(range(10)) as k)),
    n as (select agent_id, window_start, count(*) as restarts from w group by 1, 2)
    select agent_id, window_start, restarts from n where restarts >= {f.FLAP_THRESHOLD}""")
def live_flapping(spark, sf):
    """Restarts per sliding ten minutes, arriving in no order."""
    at = f.rfc3339(F.col("started_at"))
    restarts = f.restarts(messages(spark, sf)).select("agent_id", at.alias("restarted_at"), (F.col("seq") % 997).alias("arrival"))
    counts = live.flap_counts(spark, _feed(spark, restarts, live.flap_stream, "arrival", parts=10))
    return live.flap_windows(counts).select("agent_id", F.unix_seconds("window_start").alias("window_start"), "restarts")


# The samples of each agent's last stretch of 2,500 events, which is its newest scrape.
_NEWEST = f"""select s.* from ({SAMPLES}) s join (select concat('agent-', user_id) as scrape_id, max(event_id // 2500) as last from {{events}} group by 1) n using (scrape_id)
    where line_no // 2500 = last"""


@query(status_sql(_NEWEST) + """ union all select distinct concat('agent-', user_id), 'health', '', 'healthy', case when user_id % 5 = 0 then 0 else 1 end from {events}""")
def live_reports(spark, sf):
    """Every section of the newest scrape of each agent, from scrapes that are
    split over batches. One agent in five fails its scrape after that."""
    flat = run_sql(spark, sf, SCRAPES)
    lines = flat.select(F.col("scrape_id").alias("agent_id"), F.floor(F.col("line_no") / 2500).alias("scrape_id"), "line_no", "text")
    size = lines.groupBy("agent_id", "scrape_id").agg(F.count("*").alias("lines"))
    started, scraped = F.lit("2024-01-01T00:00:00Z"), F.timestamp_seconds(F.lit(STATUS_AT))
    failed = lines.groupBy("agent_id").agg(F.max("scrape_id").alias("scrape_id"), F.max("line_no").alias("line_no")).filter(
        F.element_at(F.split("agent_id", "-"), 2).cast("int") % 5 == 0).select(
        "agent_id", (F.col("scrape_id") + 1).alias("scrape_id"), "line_no", F.lit(1).cast("bigint").alias("lines"), F.lit("connection refused").alias("error"))
    rows = lines.join(size, ["agent_id", "scrape_id"]).unionByName(failed, allowMissingColumns=True).withColumns({"started_at": started, "scraped_at": scraped})
    routes, receivers, exporters = one_pipeline(spark, sf)
    start = lambda stream, out, cp: live.report_stream(stream, routes, receivers, exporters, out, cp, every=None)
    reports = live.current_reports(spark, _feed(spark, rows, start, "line_no"))
    health = reports.select("agent_id", F.lit("health").alias("section"), F.lit("").alias("component"), F.lit("healthy").alias("field"), F.col("healthy").cast("bigint").alias("value"))
    return shown_status(reports).unionByName(health)
