"""Config-document, routing and topology queries over a fleet of agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as c
from ..operators import metrics as m
from ..operators import routing as r
from ..operators import topology as t
from .registry import query, run_spread, run_sql
from .volume import attribution_sql

# One JSON document per customer and version, with an orphan here, a dangling
# reference there, literal and referenced secrets.
_DOC = """concat('{{"receivers":{{"syslog/r0":{{"protocol":"rfc3164","udp":{{"listen_address":"0.0.0.0:', 500 + c_nationkey + {v}, '"}}}},"syslog/r1":{{}},"file_log/r2":{{"include":["/var/log/', c_mktsegment, '/*.log"],"start_at":"end"}}',
    case when c_custkey % 4 = 0 then ',"file_log/orphan":{{"include":[]}}' else '' end,
    '}},"exporters":{{"hec/x0":{{"endpoint":"https://e', c_custkey % 7, '","token":"', case when c_custkey % 3 = {v} then concat('tok-', c_custkey) else '$', '{{TOKEN}}"' end, case when c_custkey % 3 = {v} then '"' else '' end, '}},"hec/x1":{{"headers":[{{"Password":{{"of":"x"}},"keep":', c_custkey % 5, '}}],"API_KEY":null}},"dataset/x2":{{"server_host":{{"use_hostname":', case when c_custkey % 5 = 0 then 'false' else 'true' end, case when c_custkey % 10 = 0 then '' else concat(',"server_host":"h', c_nationkey, '"') end, '}}}}}}',
    ',"extensions":{{"health_check":{{}},"file_storage":{{"directory":"$', '{{DIR}}/q"}}}}',
    ',"service":{{"extensions":["health_check"', case when c_custkey % 6 = 0 then '' else ',"file_storage"' end, '],"pipelines":{{"logs/main":{{"receivers":["syslog/r0","syslog/r1",5],"exporters":["hec/x0","hec/x1"]}},"logs/aux":{{"receivers":["file_log/r2","file_log/r2"],"exporters":["hec/x1"', case when c_custkey % 9 = 0 then ',"debug/ghost"' else '' end, case when {v} = 2 and c_custkey % 2 = 0 then ',"dataset/x2"' else '' end, ']}}', case when c_custkey % 8 = 0 then ',"audit/extra":{{"receivers":[],"exporters":["dataset/x2"]}}' else '' end, '}}}}}}')"""
# Two adjacent strings keep the reference sign out of either engine's templating.
_DOC = _DOC.replace("""else '$', '{{TOKEN}}"' end""", """else concat('$', '{{TOKEN}}"') end""")


def docs_sql(version: int) -> str:
    text = _DOC.replace("{v}", str(version)).replace("{{", "{").replace("}}", "}")
    return f"select concat('agent-', c_custkey) as agent_id, {version} as version, {text} as doc from {{customer}}"


DOCS = docs_sql(1)
BOTH = f"{docs_sql(1)} union all {docs_sql(2)}"


def docs(spark, sf, version: int = 1):
    return run_spread(spark, sf, docs_sql(version))


COMPONENTS = " union all ".join(
    f"select agent_id, '{category}' as category, unnest(json_keys(doc, '$.{section}')) as id from ({DOCS})" for section, category in c.CATEGORY.items())
_STRINGS = "list_transform(list_filter(from_json(def->'$.{0}', '[\"JSON\"]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$')"
ROUTES = f"""select agent_id, pipeline, {_STRINGS.format('receivers')} as receivers, {_STRINGS.format('exporters')} as exporters from
    (select agent_id, e.key as pipeline, e.value as def from ({DOCS}) d, json_each(d.doc, '$.service.pipelines') e)"""


@query(COMPONENTS)
def config_components(spark, sf):
    return c.config_components(docs(spark, sf))


@query(f"select agent_id, pipeline, array_to_string(receivers, ',') as receivers, array_to_string(exporters, ',') as exporters from ({ROUTES})")
def config_routes(spark, sf):
    out = c.config_routes(docs(spark, sf))
    return out.select("agent_id", "pipeline", F.array_join("receivers", ",").alias("receivers"), F.array_join("exporters", ",").alias("exporters"))


_LEAVES = """select agent_id, replace(replace(t.fullkey, '"', ''), '$.', '') as path,
    case when t.type = 'VARCHAR' then t.atom->>'$' else coalesce(t.atom, t.value)::varchar end as value,
    (t.type = 'VARCHAR')::integer as is_text from ({docs}) d, json_tree(d.doc) t
    where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')"""
LEAVES = _LEAVES.format(docs=DOCS)


def path_text(col):
    """Keys joined with dots, list positions in brackets."""
    return F.replace(F.array_join(col, "."), F.lit(".["), F.lit("["))


def _shown(leaves):
    return leaves.select("agent_id", path_text("path").alias("path"), "value", F.col("is_text").cast("int").alias("is_text"))


@query(LEAVES)
def config_leaves(spark, sf):
    return _shown(c.config_leaves(docs(spark, sf)))


_SENSITIVE = r"(?i)^(.*?\.(?:token|password|secret|api_key|apikey))(?:\.|\[|$)"


@query(f"""select distinct agent_id, case when hit then regexp_extract(path, '{_SENSITIVE}', 1) else path end as path,
    case when hit then '{c.REDACTED}' else value end as value, case when hit then 1 else is_text end as is_text
    from (select *, regexp_matches(path, '{_SENSITIVE}') as hit from ({LEAVES}))""")
def redacted_leaves(spark, sf):
    return _shown(c.redact(docs(spark, sf)))


# Objects and lists in each other, 42 to 46 deep.
_DEEP = """select concat('agent-', c_custkey) as agent_id, concat('{{"agent":', repeat('{{"k":[', 20 + c_custkey % 3), '{{"token":{{"t":', c_custkey, '}},"n":"x', c_custkey, '"}}',
    repeat(']}}', 20 + c_custkey % 3), '}}') as doc from {customer}""".replace("{{", "{").replace("}}", "}")
_DEEP_LEAVES = _LEAVES.format(docs=_DEEP)


@query(_DEEP_LEAVES)
def deep_config_leaves(spark, sf):
    return _shown(c.config_leaves(run_spread(spark, sf, _DEEP)))


@query(f"""select agent_id, regexp_replace(path, 'token[.]t$', 'token') as path, case when ends_with(path, 'token.t') then '{c.REDACTED}' else value end as value, 1 as is_text
    from ({_DEEP_LEAVES})""")
def deep_redacted_leaves(spark, sf):
    return _shown(c.redact(run_spread(spark, sf, _DEEP)))


@query(f"""select agent_id, path, value from ({LEAVES}) where regexp_matches(path, '{_SENSITIVE}') and not contains(value, '$' || '{{')
    and value not in ('', '{{}}', '[]', 'null')""")
def plaintext_secrets(spark, sf):
    return _shown(c.plaintext_secrets(c.config_leaves(docs(spark, sf)))).drop("is_text")


@query(f"select agent_id, path, case when is_text = 1 and contains(value, '$' || '{{') then '{c.PLACEHOLDER}' else value end as value from ({LEAVES})")
def placeholder_leaves(spark, sf):
    return _shown(c.placeholder(c.config_leaves(docs(spark, sf)))).drop("is_text")


@query(f"""select agent_id, doc->'receivers'->'syslog/r0'->'udp'->>'listen_address' as address, doc->'receivers'->'syslog/r0'->>'protocol' as protocol,
    doc->'exporters'->'hec/x0'->>'token' as token, null::varchar as missing from ({DOCS})""")
def config_values(spark, sf):
    df = c.with_variant(docs(spark, sf))
    df = c.config_get(df, ["receivers", "syslog/r0", "udp", "listen_address"], "address")
    df = c.config_get(df, "receivers.syslog/r0.protocol", "protocol")
    df = c.config_get(df, ["exporters", "hec/x0", "token"], "token")
    df = c.config_get(df, "receivers.nope.deeper", "missing")
    return df.drop("doc", "version")


@query(f"""select agent_id, path, case when a.value is null then 'added' when b.value is null then 'removed' else 'changed' end as change,
    a.value as old, b.value as new from ({LEAVES}) a full join ({_LEAVES.format(docs=docs_sql(2))}) b using (agent_id, path)
    where a.value is distinct from b.value""")
def config_diff(spark, sf):
    out = c.config_diff(c.config_leaves(docs(spark, sf, 1)), c.config_leaves(docs(spark, sf, 2)))
    return out.withColumn("path", path_text("path"))


@query(f"""select category, split_part(id, '/', 1) as type, count(*) as components, count(distinct agent_id) as agents
    from ({COMPONENTS}) group by 1, 2""")
def component_census(spark, sf):
    return c.component_census(c.config_components(docs(spark, sf)))


# --- definitions: orphans, dangling references, audit ---

_MEMBERS = f"""select agent_id, pipeline, 'receiver' as category, unnest(receivers) as id from ({ROUTES})
    union all select agent_id, pipeline, 'exporter', unnest(exporters) from ({ROUTES})"""
_ORPHANS = f"""select agent_id, category, id from ({COMPONENTS}) x where category <> 'extension'
    and not exists (select 1 from ({_MEMBERS}) y where y.agent_id = x.agent_id and y.category = x.category and y.id = x.id)"""
_DANGLING = f"""select agent_id, category, id, pipeline from ({_MEMBERS}) x
    where not exists (select 1 from ({COMPONENTS}) y where y.agent_id = x.agent_id and y.category = x.category and y.id = x.id)"""


@query(_ORPHANS)
def orphans(spark, sf):
    return r.orphan_components(*c.explode_config(docs(spark, sf)))


@query(_DANGLING)
def dangling(spark, sf):
    return r.dangling_refs(*c.explode_config(docs(spark, sf)))


@query(f"select agent_id, pipeline as route from ({ROUTES}) where list_contains(exporters, 'dataset/x2')")
def routes_referencing(spark, sf):
    out = r.pipelines_referencing(c.config_routes(docs(spark, sf, 1)), "exporter", "dataset/x2")
    return out.withColumnRenamed("pipeline", "route")


@query(f"""select agent_id, pipeline as route, array_to_string(list_filter(receivers, lambda x: x <> 'file_log/r2'), ',') as receivers,
    len(list_filter(receivers, lambda x: x <> 'file_log/r2')) as n from ({ROUTES})""")
def stripped_routes(spark, sf):
    out = r.strip_from_pipelines(c.config_routes(docs(spark, sf)), "receiver", "file_log/r2")
    return out.select("agent_id", F.col("pipeline").alias("route"), F.array_join("receivers", ",").alias("receivers"),
                      F.size("receivers").cast("bigint").alias("n"))


@query(f"select agent_id, string_agg(id, ',' order by id) as extensions from ({COMPONENTS}) where category = 'extension' group by 1")
def derived_extensions(spark, sf):
    out = r.derive_extensions(c.config_components(docs(spark, sf)))
    return out.withColumn("extensions", F.array_join("extensions", ","))


_EXT = f"select agent_id, unnest(from_json(doc->'$.service.extensions', '[\"VARCHAR\"]')) as id from ({DOCS})"


@query(f"""select agent_id, 'unknown signal' as rule, pipeline as subject from ({ROUTES}) where split_part(pipeline, '/', 1) not in ('logs', 'metrics', 'traces')
    union all select agent_id, 'no receivers', pipeline from ({ROUTES}) where len(receivers) = 0
    union all select agent_id, 'no exporters', pipeline from ({ROUTES}) where len(exporters) = 0
    union all select agent_id, 'undefined component', id from ({_DANGLING})
    union all select agent_id, 'unused component', id from ({_ORPHANS})
    union all select agent_id, 'extension not activated', id from ({COMPONENTS}) x where category = 'extension'
        and not exists (select 1 from ({_EXT}) y where y.agent_id = x.agent_id and y.id = x.id)
    union all select agent_id, 'no host fallback', 'dataset/x2' from ({DOCS}) where (doc->'exporters'->'dataset/x2'->'server_host'->>'use_hostname') = 'false'
        and (doc->'exporters'->'dataset/x2'->'server_host'->>'server_host') is null""")
def config_audit(spark, sf):
    d = docs(spark, sf)
    return r.config_audit(*c.explode_config(d), c.config_active_extensions(d), c.config_host_settings(d))


# --- records through pipelines ---

_RECORDS = "select event_id as seq, case event_id % 4 when 3 then 'syslog/none' when 2 then 'file_log/r2' else concat('syslog/r', event_id % 4) end as receiver, concat('agent-', user_id) as agent_id from {events}"
_IN = f"""select e.seq, e.agent_id, e.receiver, m.pipeline from ({_RECORDS}) e
    join (select agent_id, pipeline, unnest(receivers) as receiver from ({ROUTES})) m using (agent_id, receiver)"""


@query(f"select seq, agent_id, receiver, pipeline as route from ({_IN})")
def route_fanin(spark, sf):
    out = r.route_in(run_sql(spark, sf, _RECORDS), c.config_routes(docs(spark, sf)), ["agent_id"])
    return out.select("seq", "agent_id", "receiver", F.col("pipeline").alias("route"))


@query(f"""select x.exporter, i.receiver, count(*) as records, count(distinct i.seq) as distinct_records from ({_IN}) i
    join (select agent_id, pipeline, unnest(exporters) as exporter from ({ROUTES})) x using (agent_id, pipeline) group by 1, 2""")
def route_fanout(spark, sf):
    routes = c.config_routes(docs(spark, sf))
    out = r.route_out(r.route_in(run_sql(spark, sf, _RECORDS), routes, ["agent_id"]), routes, ["agent_id"])
    per_record = out.groupBy("exporter", "receiver", "seq").agg(F.count("*").alias("n"))
    return per_record.groupBy("exporter", "receiver").agg(F.sum("n").alias("records"), F.count("*").alias("distinct_records"))


# --- per-agent attribution and flow graph ---

_ACC = """select concat('agent-', o_custkey) as agent_id, case o_orderkey % 3 when 2 then 'file_log/r2' else concat('syslog/r', o_orderkey % 3) end as id,
    cast(sum(o_orderkey % 97) as bigint) as n from {orders} group by 1, 2"""
_OUT = """select concat('agent-', o_custkey) as agent_id, concat('hec/x', o_orderkey % 2) as id, cast(sum(case when o_orderstatus {op} 'F' then o_orderkey % 89 else 0 end) as bigint) as n
    from {{orders}} group by 1, 2"""
_SENT, _FAILED = _OUT.format(op="<>"), _OUT.format(op="=")
_ATTR = attribution_sql(ROUTES, _ACC, _SENT, _FAILED)


def _attributed(spark, sf):
    run = lambda sql: run_sql(spark, sf, sql)
    return m.attribute_pipelines(c.config_routes(docs(spark, sf)), run(_ACC), run(_SENT), run(_FAILED))


@query(_ATTR.replace("select p.agent_id, p.pipeline,", "select p.agent_id, p.pipeline as route,"))
def attribution_by_agent(spark, sf):
    return _attributed(spark, sf).withColumnRenamed("pipeline", "route")


# One pass over the orders: what receivers took in and what exporters were given.
_VOLUME = """select concat('agent-', o_custkey) as agent_id, 'events_in' as field, inline(array(
    struct('receivers' as section, case o_orderkey % 3 when 2 then 'file_log/r2' else concat('syslog/r', o_orderkey % 3) end as component, o_orderkey % 97 as value),
    struct('exporters' as section, concat('hec/x', o_orderkey % 2) as component, o_orderkey % 89 as value))) from {orders}"""


def _graphs(spark, sf, locale_order: bool = False):
    return t.agent_graphs(run_sql(spark, sf, DOCS), run_sql(spark, sf, _VOLUME), pipeline_volume=True, locale_order=locale_order)


_FLOWS = f"""select agent_id, id, type, coalesce(n, 0)::bigint as flow from (
        select agent_id, id, category as type from ({COMPONENTS}) where category <> 'extension'
        union all select agent_id, pipeline, 'pipeline' from ({ROUTES})) nodes
    left join (select agent_id, id, 'receiver' as type, n from ({_ACC})
        union all select agent_id, pipeline, 'pipeline', events_in from ({_ATTR})
        union all select agent_id, id, 'exporter', sum(n) from (select * from ({_SENT}) union all select * from ({_FAILED})) group by 1, 2) c
    using (agent_id, id, type)"""
_EDGES = f"""select agent_id, unnest(receivers) as "from", pipeline as "to", 'in' as kind from ({ROUTES})
    union all select agent_id, pipeline, unnest(exporters), 'out' from ({ROUTES})"""


@query(f"select agent_id, id, type, flow from ({_FLOWS})")
def topology_nodes(spark, sf):
    return t.graph_nodes(_graphs(spark, sf)).select("agent_id", "id", "type", "flow")


@query(_EDGES)
def topology_edges(spark, sf):
    return t.topology_edges(c.config_routes(docs(spark, sf)))


_EDGE_FLOW = f"""select e.agent_id, e."from", e."to", e.kind, s.flow from ({_EDGES}) e
    join ({_FLOWS}) s on s.agent_id = e.agent_id and s.id = e."from" and s.type = case e.kind when 'in' then 'receiver' else 'pipeline' end
    where exists (select 1 from ({_FLOWS}) d where d.agent_id = e.agent_id and d.id = e."to" and d.type = case e.kind when 'in' then 'pipeline' else 'exporter' end)"""
_TOTAL = f"select agent_id, sum(flow) as total from ({_FLOWS}) where type = 'receiver' group by 1"


def _percent(flow: str) -> str:
    return f"cast(case when total > 0 then round({flow} / total * 100) else 0 end as integer)"


@query(f"select e.*, {_percent('flow')} as percent from ({_EDGE_FLOW}) e join ({_TOTAL}) using (agent_id)")
def edge_flow_percent(spark, sf):
    return t.graph_links(_graphs(spark, sf)).select("agent_id", "from", "to", "kind", "flow", "percent")


@query(f"""select agent_id, id, type, flow, {_percent('flow')} as percent, row_number() over (partition by agent_id, type order by flow desc, id) as rank
    from ({_FLOWS}) join ({_TOTAL}) using (agent_id)""")
def ranked_nodes(spark, sf):
    return t.graph_nodes(_graphs(spark, sf))


# Ids that differ in case, and agents without any events, so that ids decide the ranks.
_MIXED = f"""select agent_id, replace(replace(replace(doc, 'hec/x1', 'HEC/x1'), 'syslog/r1', 'Syslog/r0'), 'file_log/r2', 'file/log') as doc from ({DOCS})"""
# What the collation does to these ids: blanks and signs first, then digits, then letters whatever their case, lower case first.
_LOCALE = "translate(lower(id), '_/', '!#'), id desc"


@query(f"""select agent_id, id, type, row_number() over (partition by agent_id, type order by flow desc, {_LOCALE}) as rank from (
    select agent_id, replace(replace(replace(id, 'hec/x1', 'HEC/x1'), 'syslog/r1', 'Syslog/r0'), 'file_log/r2', 'file/log') as id, type, 0 as flow from ({_FLOWS}))""")
def ranked_nodes_locale(spark, sf):
    """Ranks in the locale order, which is the default."""
    none = run_sql(spark, sf, _VOLUME).limit(0)
    return t.graph_nodes(t.agent_graphs(run_sql(spark, sf, _MIXED), none)).select("agent_id", "id", "type", "rank")


@query(f"select agent_id, count(*) as nodes, max(flow) as flow from ({_FLOWS}) where substr(agent_id, 7)::integer % 3 <> 0 group by 1")
def empty_graphs(spark, sf):
    """Every third agent has nothing configured: it has counters, but no graph."""
    shown = run_sql(spark, sf, f"select agent_id, case when cast(substr(agent_id, 7) as int) % 3 = 0 then '{{}}' else doc end as doc from ({DOCS})")
    nodes = t.graph_nodes(t.agent_graphs(shown, run_sql(spark, sf, _VOLUME), pipeline_volume=True))
    return nodes.groupBy("agent_id").agg(F.count("*").alias("nodes"), F.max("flow").alias("flow"))


@query(f"select f.* from ({_FLOWS}) f where agent_id in (select concat('agent-', c_custkey) from {{customer}} where c_acctbal > 9000)")
def compared_agents(spark, sf):
    chosen = run_sql(spark, sf, "select concat('agent-', c_custkey) as agent_id from {customer} where c_acctbal > 9000")
    return t.compare_topology(t.graph_nodes(_graphs(spark, sf)).select("agent_id", "id", "type", "flow"), chosen)


# Links by pipeline, in the order of its lists.
_LISTED = f"""select agent_id, unnest(receivers) as "from", pipeline as "to", 'in' as kind, pipeline, generate_subscripts(receivers, 1) as pos from ({ROUTES})
    union all select agent_id, pipeline, unnest(exporters), 'out', pipeline, generate_subscripts(exporters, 1) from ({ROUTES})"""
_LINKS = _EDGE_FLOW.replace(f"({_EDGES}) e", f"({_LISTED}) e").replace("e.kind, s.flow", "e.kind, e.pipeline, e.pos, s.flow")


@query(f"""select agent_id, "from", "to", flow, coalesce(sum(flow) over (partition by agent_id, kind, "to" order by pipeline, pos rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
    from ({_LINKS})""")
def inbound_offsets(spark, sf):
    return t.graph_links(_graphs(spark, sf)).select("agent_id", "from", "to", "flow", "offset")
