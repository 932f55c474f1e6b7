"""Volume accounting queries: scrapes, counters, attribution, deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.fleet import snapshot_counters
from ..schemas import SNAPSHOT
from ..sources.scrapes import read_metric_scrapes
from .registry import query, run_spread, run_sql

# One scrape per user, one text line per event: counters, process gauges,
# comments and broken lines.
_N = "cast(round(value * 100) as bigint)"
SCRAPES = f"""select concat('agent-', user_id) as scrape_id, event_id as line_no, case event_type
    when 'signup' then concat('{m.ACCEPTED}{{receiver="', case when event_id % 11 = 0 then '' else concat('syslog/r', event_id % 6) end,
        '",transport="', case when event_id % 2 = 0 then 'udp' else 'tcp' end, '"}} ', {_N}, case when event_id % 3 = 0 then '.75' else '' end)
    when 'view' then concat('{m.SENT}{{exporter="hec/x', event_id % 5, '"}} ', {_N})
    when 'purchase' then concat('  {m.FAILED}{{exporter="hec/x', event_id % 5, '",reason="a, b"}}   ', event_id % 40, ' ')
    when 'click' then case event_id % 3 when 0 then concat('{m.CPU_SECONDS} ', {_N}, '.5') when 1 then concat('{m.RSS_BYTES} ', {_N}, '000')
        else concat('{m.HEAP_BYTES} ', {_N}, '00.25') end
    else case event_id % 6 when 0 then '# HELP something' when 1 then '' when 2 then concat('broken{{a="b" ', event_id)
        when 3 then concat('{m.ACCEPTED}{{receiver="syslog/r1"}} 12d') when 4 then '{m.ACCEPTED}{{receiver="syslog/r1"}} many'
        else concat('{m.ACCEPTED}{{receiver="syslog/unknown"}} ', event_id) end end as text from {{events}}"""

_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)$"
# DuckDB's cast refuses what the sample grammar refuses, but for the suffix.
SAMPLES = f"""select scrape_id, line_no, g.family as family, g.labels as labels,
    regexp_extract(g.labels, '[{{,]receiver="([^"]*)"', 1) as receiver, regexp_extract(g.labels, '[{{,]exporter="([^"]*)"', 1) as exporter,
    try_cast(g.number as double) as value
    from (select *, regexp_extract(trim(text), '{_LINE}', ['family', 'labels', 'number']) as g from ({SCRAPES}) where regexp_matches(trim(text), '{_LINE}'))
    where try_cast(g.number as double) is not null and not starts_with(text, '#')"""


def samples(spark, sf):
    return read_metric_scrapes(run_spread(spark, sf, SCRAPES))


IDS = """select distinct concat('agent-', user_id) as scrape_id, concat('{prefix}', event_id % {n}) as id from {{events}}"""
RECEIVERS = IDS.format(prefix="syslog/r", n=8)
EXPORTERS = IDS.format(prefix="hec/x", n=6)


@query(f"""select scrape_id, line_no, family, receiver, exporter, cast(value * 4 as bigint) as quarters from ({SAMPLES})""")
def scrape_samples(spark, sf):
    label = lambda k: F.coalesce(F.col("labels")[k], F.lit("")).alias(k)
    return samples(spark, sf).select("scrape_id", "line_no", "family", label("receiver"), label("exporter"),
                                     (F.col("value") * 4).cast("bigint").alias("quarters"))


def _sum(family: str, label: str) -> str:
    return f"""select scrape_id, {label} as id, sum(trunc(value)::bigint)::bigint as n from ({SAMPLES})
        where family = '{family}' and {label} <> '' group by 1, 2"""


@query(_sum(m.ACCEPTED, "receiver"))
def sum_by_label(spark, sf):
    return m.sum_by_label(samples(spark, sf), m.ACCEPTED, "receiver")


@query(f"select i.scrape_id, i.id, coalesce(s.n, 0) as events_in from ({RECEIVERS}) i left join ({_sum(m.ACCEPTED, 'receiver')}) s using (scrape_id, id)")
def receiver_counters(spark, sf):
    return m.receiver_counters(samples(spark, sf), run_sql(spark, sf, RECEIVERS))


@query(f"""select i.scrape_id, i.id, coalesce(s.n, 0) as batches_sent, coalesce(f.n, 0) as batches_failed,
    coalesce(s.n, 0) + coalesce(f.n, 0) as events_in from ({EXPORTERS}) i
    left join ({_sum(m.SENT, 'exporter')}) s using (scrape_id, id) left join ({_sum(m.FAILED, 'exporter')}) f using (scrape_id, id)""")
def exporter_counters(spark, sf):
    return m.exporter_counters(samples(spark, sf), run_sql(spark, sf, EXPORTERS))


def _first(family: str) -> str:
    return f"coalesce(min_by(value, line_no) filter (family = '{family}'), 0)"


@query(f"select scrape_id, {_first(m.CPU_SECONDS)} as value from ({SAMPLES}) group by 1")
def first_value(spark, sf):
    return m.first_value_of(samples(spark, sf), m.CPU_SECONDS)


@query(f"""select scrape_id, {_first(m.CPU_SECONDS)} as cpu_seconds, trunc({_first(m.RSS_BYTES)})::bigint as memory_rss_bytes,
    trunc({_first(m.HEAP_BYTES)})::bigint as heap_alloc_bytes from ({SAMPLES}) group by 1""")
def process_usage(spark, sf):
    return m.process_usage(samples(spark, sf))


def attribution_sql(routes: str, accepted: str, sent: str, failed: str) -> str:
    """DuckDB: routes(agent_id, pipeline, receivers, exporters) with list columns."""
    return f"""with routes as ({routes}), accepted as ({accepted}), sent as ({sent}), failed as ({failed}),
    vol as (select r.agent_id, r.pipeline, coalesce(sum(a.n), 0)::bigint as events_in
        from (select agent_id, pipeline, unnest(receivers) as id from routes) r left join accepted a using (agent_id, id) group by 1, 2),
    pin as (select r.agent_id, r.pipeline, coalesce(v.events_in, 0)::bigint as events_in from routes r left join vol v using (agent_id, pipeline)),
    uses as (select u.agent_id, u.pipeline, u.id, p.events_in from (select agent_id, pipeline, unnest(exporters) as id from routes) u
        join pin p using (agent_id, pipeline)),
    shares as (select *, case when sum(events_in) over w > 0 then events_in::double / sum(events_in) over w else 1.0::double / count(*) over w end as share
        from uses window w as (partition by agent_id, id)),
    split as (select s.agent_id, s.pipeline, round(sum(s.share * coalesce(t.n, 0)))::bigint as o, round(sum(s.share * coalesce(f.n, 0)))::bigint as d
        from shares s left join sent t using (agent_id, id) left join failed f using (agent_id, id) group by 1, 2)
    select p.agent_id, p.pipeline, p.events_in, coalesce(s.o, 0) as events_out, coalesce(s.d, 0) as events_dropped
    from pin p left join split s using (agent_id, pipeline)"""


# One shared graph: suppliers are receivers, nations pipelines, regions exporters.
SHARED_RECEIVERS = """select 'fleet' as agent_id, concat('logs/', n_name) as pipeline, concat('syslog/s', s_suppkey) as id
    from {nation} join {supplier} on s_nationkey = n_nationkey"""
SHARED_EXPORTERS = " union all ".join(f"""select 'fleet' as agent_id, concat('logs/', n_name) as pipeline, concat('hec/r', (n_regionkey + {k}) % 5) as id
    from {{nation}} join (select distinct s_nationkey from {{supplier}}) s on s_nationkey = n_nationkey""" for k in (0, 1))
_SHARED_ROUTES = f"""select agent_id, pipeline, receivers, exporters from (select agent_id, pipeline, list(id) as receivers from ({SHARED_RECEIVERS}) group by 1, 2)
    join (select agent_id, pipeline, list(id) as exporters from ({SHARED_EXPORTERS}) group by 1, 2) using (agent_id, pipeline)"""
SHARED_ACCEPTED = "select 'fleet' as agent_id, concat('syslog/s', l_suppkey) as id, count(*) as n from {lineitem} group by l_suppkey"
SHARED_SENT = """select 'fleet' as agent_id, concat('hec/r', n.n_regionkey) as id, count(*) filter (where l.l_returnflag {op} 'R') as n
    from {{lineitem}} l join {{supplier}} s on s.s_suppkey = l.l_suppkey join {{nation}} n on n.n_nationkey = s.s_nationkey group by n.n_regionkey"""


@query(attribution_sql(_SHARED_ROUTES, SHARED_ACCEPTED, SHARED_SENT.format(op="<>"), SHARED_SENT.format(op="=")))
def attribution(spark, sf):
    run = lambda sql: run_sql(spark, sf, sql)
    return m.attribute_members(run(SHARED_RECEIVERS), run(SHARED_EXPORTERS), run(SHARED_ACCEPTED), run(SHARED_SENT.format(op="<>")), run(SHARED_SENT.format(op="=")))


DELIVERIES = """select concat('hec/c', o_custkey % 50) as exporter, o_orderkey as seq,
    case o_orderstatus when 'F' then 'failure' when 'P' then 'retry' else 'success' end as kind,
    1 + o_orderkey % 500 as batch_len, concat('timeout on batch ', o_orderkey) as message, o_orderdate as at from {orders}"""


@query(f"""select exporter, coalesce(sum(batch_len) filter (kind <> 'retry'), 0)::bigint as events_in,
    count(*) filter (kind = 'success') as batches_sent, count(*) filter (kind = 'failure') as batches_failed,
    count(*) filter (kind = 'retry') as retries, max_by(message, seq) filter (kind = 'failure') as last_error,
    epoch(max_by("at", seq) filter (kind = 'failure'))::bigint as last_error_at from ({DELIVERIES}) group by 1""")
def delivery_counters(spark, sf):
    out = m.delivery_counters(run_sql(spark, sf, DELIVERIES))
    return out.withColumn("last_error_at", F.datediff("last_error_at", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400)


OUTCOMES = """select concat('logs/p', user_id % 40) as pipeline, concat('syslog/u', user_id) as receiver,
    case when event_type = 'error' and event_id % 3 = 0 then 'dead_lettered' when event_type = 'error' then 'dropped' else 'out' end as outcome,
    event_id % 7 = 0 as parse_error from {events}"""


def _outcomes_sql(key: str) -> str:
    return f"""select {key}, count(*) as events_in, count(*) filter (outcome = 'out') as events_out,
    count(*) filter (outcome = 'dropped') as events_dropped, count(*) filter (outcome = 'dead_lettered') as events_dead_lettered,
    count(*) filter (parse_error) as parse_errors from ({OUTCOMES}) group by 1"""


@query(_outcomes_sql("pipeline"))
def outcome_counters(spark, sf):
    return m.outcome_counters(run_sql(spark, sf, OUTCOMES))


_REGISTERED = "select concat('syslog/u', c_custkey) as receiver from {customer} where c_custkey % 2 = 0"


@query(f"""select r.receiver, coalesce(events_in, 0) as events_in, coalesce(events_out, 0) as events_out, coalesce(events_dropped, 0) as events_dropped,
    coalesce(events_dead_lettered, 0) as events_dead_lettered, coalesce(parse_errors, 0) as parse_errors
    from ({_REGISTERED}) r left join ({_outcomes_sql('receiver')}) c using (receiver)""")
def registered_counters(spark, sf):
    counted = m.outcome_counters(run_sql(spark, sf, OUTCOMES), ["receiver"])
    return m.with_registry(counted, run_sql(spark, sf, _REGISTERED), ["receiver"])


# Counters of every customer's collector, in long form.
COUNTERS = """select concat('agent-', o_custkey) as agent_id, 'receivers' as section, concat('syslog/r', o_orderkey % 4) as component, 'events_in' as field, sum(o_orderkey % 997) as value from {orders} group by 1, 3
    union all select concat('agent-', o_custkey), 'pipelines', concat('logs/p', o_orderkey % 2), 'events_in', sum(o_orderkey % 997) from {orders} group by 1, 3
    union all select concat('agent-', o_custkey), 'pipelines', concat('logs/p', o_orderkey % 2), 'events_dropped', sum(case o_orderstatus when 'F' then o_orderkey % 3 else 0 end) from {orders} group by 1, 3
    union all select concat('agent-', o_custkey), 'pipelines', concat('logs/p', o_orderkey % 2), 'parse_errors', sum(case when o_orderkey % 13 = 0 then 1 else 0 end) from {orders} group by 1, 3
    union all select concat('agent-', o_custkey), 'exporters', concat('hec/x', o_orderkey % 3), 'events_in', sum(o_orderkey % 89) from {orders} group by 1, 3
    union all select concat('agent-', o_custkey), 'exporters', concat('hec/x', o_orderkey % 3), 'batches_failed', sum(case when o_orderstatus = 'F' and o_orderkey % 5 = 0 then 1 else 0 end) from {orders} group by 1, 3"""
COUNTERS = f"select agent_id, section, component, field, cast(value as bigint) as value from ({COUNTERS})"


@query(f"""select agent_id, section, component, value, cast(case when m > 0 then round(value / m * 100) else 0 end as integer) as percent
    from (select *, max(value) over (partition by agent_id, section) as m from ({COUNTERS}) where field = 'events_in')""")
def relative_volume(spark, sf):
    return m.relative_volume(run_sql(spark, sf, COUNTERS))


@query(f"""select agent_id, section, component, string_agg(field, ',' order by field) as problems, sum(value)::bigint as affected from ({COUNTERS})
    where value > 0 and ((section = 'pipelines' and field in ('events_dropped', 'parse_errors')) or (section = 'exporters' and field = 'batches_failed'))
    group by 1, 2, 3""")
def problem_components(spark, sf):
    return m.problem_rows(run_sql(spark, sf, COUNTERS))


@query(f"select agent_id, section, count(distinct component) as components from ({COUNTERS}) group by 1, 2")
def component_overview(spark, sf):
    return m.overview(run_sql(spark, sf, COUNTERS))


# A counter that resets now and then, scraped once per event.
_SCRAPED = "select concat('agent-', user_id) as agent_id, event_type as component, event_id as seq, event_id % 1000 * 3 as value from {events}"


@query(f"""with d as (select *, lag(value) over (partition by agent_id, component order by seq) as before from ({_SCRAPED}))
    select agent_id, component, seq, value, coalesce(value < before, false)::integer as reset,
    case when value < before then value else value - before end as delta from d""")
def counter_deltas(spark, sf):
    out = m.counter_deltas(run_sql(spark, sf, _SCRAPED), ["agent_id", "component"], "seq", span=50_000)
    return out.withColumn("reset", F.col("reset").cast("int"))


# Every agent runs one pipeline over three receivers and two exporters.
_AGENTS = "select distinct concat('agent-', user_id) as agent_id from {events}"
_ONE = f"select agent_id, 'logs/all' as pipeline, {{pack}}('syslog/r0', 'syslog/r1', 'syslog/r2') as receivers, {{pack}}('hec/x0', 'hec/x1') as exporters from ({_AGENTS})"


def _one(pack: str) -> str:
    return _ONE.replace("{pack}", pack)


def _by_agent(family: str, label: str) -> str:
    return f"select scrape_id as agent_id, id, n from ({_sum(family, label)})"


_ATTRIBUTED = attribution_sql(_one("list_value"), _by_agent(m.ACCEPTED, "receiver"), _by_agent(m.SENT, "exporter"), _by_agent(m.FAILED, "exporter"))
_IDS = "select agent_id, unnest({column}) as id from ({routes})"


_STATUS = f"""select agent_id, 'receivers' as section, id as component, 'events_in' as field, coalesce(n, 0)::bigint as value
        from ({_IDS.format(column='receivers', routes=_one('list_value'))}) left join ({_by_agent(m.ACCEPTED, 'receiver')}) using (agent_id, id)
    union all select agent_id, 'pipelines', pipeline, unnest(['events_in', 'events_out', 'events_dropped']), unnest([events_in, events_out, events_dropped]) from ({_ATTRIBUTED})
    union all select agent_id, 'exporters', id, unnest(['events_in', 'batches_sent', 'batches_failed']), unnest([coalesce(s.n, 0) + coalesce(f.n, 0), coalesce(s.n, 0), coalesce(f.n, 0)])
        from ({_IDS.format(column='exporters', routes=_one('list_value'))}) left join ({_by_agent(m.SENT, 'exporter')}) s using (agent_id, id)
        left join ({_by_agent(m.FAILED, 'exporter')}) f using (agent_id, id)"""


@query(_STATUS)
def status_snapshot(spark, sf):
    """All counters of every agent's scrape in one long table."""
    found = samples(spark, sf).withColumnRenamed("scrape_id", "agent_id")
    return m.snapshot(found, *one_pipeline(spark, sf))


_ZEROS = """select agent_id, 'pipelines' as section, 'logs/all' as component, unnest(['events_dead_lettered', 'parse_errors']) as field, 0::bigint as value from ({agents})
    union all select agent_id, 'exporters', unnest(['hec/x0', 'hec/x1']), 'retries', 0 from ({agents})"""
_GRAPH = " union all ".join([
    f"select agent_id, 'topology' as section, pipeline as component, 'pipeline' as field, 1::bigint as value from ({_one('list_value')})",
    *[f"select agent_id, 'topology', id, '{kind}', 1 from ({_IDS.format(column=kind + 's', routes=_one('list_value'))})" for kind in ("receiver", "exporter")],
    *[f"select agent_id, 'topology', concat({ends}), 'edge', 1 from ({_IDS.format(column=column, routes=_one('list_value'))})"
      for column, ends in (("receivers", "id, ' -> logs/all'"), ("exporters", "'logs/all -> ', id"))]])
#: Seconds since the epoch at which documents are built; processes start with the year 2024.
STATUS_AT = 1_704_067_200 + 86_400


def status_sql(source: str = SAMPLES) -> str:
    """DuckDB: all that agents report, from a table of samples; CPU seconds in quarters."""
    gauges = f"""select agent_id, 'process' as section, '' as component, unnest(['cpu_quarters', 'memory_rss_bytes', 'heap_alloc_bytes', 'uptime_seconds']) as field,
        unnest([coalesce(trunc(cpu * 4)::bigint, 0), coalesce(rss, 0), coalesce(heap, 0), 86400]) as value from ({_AGENTS}) left join (select scrape_id as agent_id,
            {_first(m.CPU_SECONDS)} as cpu, trunc({_first(m.RSS_BYTES)})::bigint as rss, trunc({_first(m.HEAP_BYTES)})::bigint as heap from ({source}) group by 1) using (agent_id)"""
    return f"{_STATUS.replace(SAMPLES, source)} union all {_ZEROS.format(agents=_AGENTS)} union all {gauges} union all {_GRAPH}"


def one_pipeline(spark, sf):
    """The routes, receivers and exporters that every agent has."""
    routes = run_sql(spark, sf, _one("array"))
    ids = lambda column: routes.select("agent_id", F.explode(column).alias("id"))
    return routes, ids("receivers"), ids("exporters")


def shown_status(documents):
    """``snapshot_json`` of each agent in long form, as ``status_sql`` has it."""
    s = documents.select("agent_id", F.from_json("snapshot_json", SNAPSHOT).alias("s"))
    gauges = F.create_map(F.lit("cpu_quarters"), (F.col("s.process.cpu_seconds") * 4).cast("bigint"), F.lit("memory_rss_bytes"), F.col("s.process.memory_rss_bytes"),
                          F.lit("heap_alloc_bytes"), F.col("s.process.heap_alloc_bytes"), F.lit("uptime_seconds"), F.col("s.uptime_seconds"))
    process = s.select("agent_id", F.lit("process").alias("section"), F.lit("").alias("component"), F.explode(gauges).alias("field", "value"))
    part = lambda rows, component, field: rows.select("agent_id", F.lit("topology").alias("section"), component.alias("component"), field.alias("field"), F.lit(1).cast("bigint").alias("value"))
    nodes = part(s.select("agent_id", F.inline("s.topology.nodes")), F.col("id"), F.col("type"))
    edges = part(s.select("agent_id", F.inline("s.topology.edges")), F.concat_ws(" -> ", "from", "to"), F.lit("edge"))
    return snapshot_counters(documents).unionByName(process).unionByName(nodes).unionByName(edges)


@query(status_sql())
def status_documents(spark, sf):
    """The whole report of every agent: counters, process, uptime."""
    found = samples(spark, sf).withColumnRenamed("scrape_id", "agent_id")
    agents = run_sql(spark, sf, _AGENTS).withColumns({"started_at": F.lit("2024-01-01T00:00:00Z"), "scraped_at": F.timestamp_seconds(F.lit(STATUS_AT))})
    return shown_status(m.status_documents(agents, found, *one_pipeline(spark, sf)))


@query("""select event_id as seq, epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('day', ts))::bigint as uptime_seconds from {events}""")
def uptimes(spark, sf):
    moments = run_sql(spark, sf, "select event_id as seq, cast(ts as timestamp) as now, cast(date_trunc('DAY', ts) as timestamp) as started from {events}")
    return moments.select("seq", m.uptime_seconds(F.col("started"), F.col("now")).alias("uptime_seconds"))
