"""Fleet-state queries over a message log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet as f
from ..operators.metrics import problem_rows
from ..schemas import AGENT_MESSAGE
from .registry import query, run_sql

# The flat message log: user = agent, event id = arrival order. The process
# start time moves on every hundred events, so agents restart now and then.
_MINUTE = "floor(event_id / 100)"
_TWO = "lpad(cast(cast({} as bigint) as string), 2, '0')"
STARTED = ("concat('2024-01-', " + _TWO.format(f"1 + floor({_MINUTE} / 1440) % 28") + ", 'T', " + _TWO.format(f"floor({_MINUTE} / 60) % 24")
           + ", ':', " + _TWO.format(f"{_MINUTE} % 60") + ", ':00Z')")
MESSAGES = f"""select concat('agent-', user_id) as agent_id, event_id as seq, {{ts}} as ts, event_type,
    case when event_type = 'signup' then concat('host-', user_id % 37) end as hostname,
    case when event_type = 'signup' then concat('1.', event_id % 9) end as service_version,
    case when event_type = 'signup' and event_id % 3 = 0 then '127.0.0.1:7801' end as local_ui_addr,
    case event_type when 'error' then 0 when 'view' then 1 end as healthy,
    case event_type when 'error' then concat('scrape failed ', event_id) when 'view' then '' end as last_error,
    case when event_type = 'view' then concat('{{{{"started_at":"', {STARTED}, '","uptime_seconds":', event_id % 500, ',"process":{{{{"cpu_seconds":', event_id % 100, '.25,"memory_rss_bytes":', event_id * 1000, ',"heap_alloc_bytes":', event_id * 300,
        '}}}},"receivers":{{{{"syslog/r', event_id % 3, '":{{{{"events_in":', event_id % 97, '}}}}}}}},"pipelines":{{{{"logs/p":{{{{"events_in":', event_id % 97, ',"events_out":', event_id % 89, ',"events_dropped":', event_id % 4, ',"events_dead_lettered":0,"parse_errors":', event_id % 3,
        '}}}}}}}},"exporters":{{{{"hec/x":{{{{"events_in":', event_id % 89, ',"batches_sent":', event_id % 83, ',"batches_failed":', event_id % 2, ',"retries":0,"last_error":null}}}}}}}}}}}}') end as snapshot_json,
    case when event_type = 'view' then {STARTED} end as started_at,
    case when event_type = 'click' then concat('cfg ', event_id % 4) end as effective_config,
    case when event_type = 'purchase' then case event_id % 4 when 0 then 'FAILED' when 1 then 'APPLYING' else 'APPLIED' end end as config_status,
    case when event_type = 'purchase' then concat('bad line ', event_id) end as config_error,
    case when event_type = 'purchase' then case event_id % 3 when 0 then 'InstallFailed' else 'Installed' end end as package_status,
    case when event_type = 'purchase' then concat('exec failed ', event_id) end as package_error
    from {{{{events}}}}"""
# The tables' clock is UTC without a zone; read it as such in any session zone.
_MICROS = """(datediff(ts, date'1970-01-01') * 86400000000 + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000000L
    + cast(date_format(ts, 'SSSSSS') as bigint))"""
_US = {"spark": f"timestamp_micros({_MICROS})", "duck": "ts"}
SPARK_MESSAGES = MESSAGES.format(ts=_US["spark"])
DUCK = MESSAGES.format(ts=_US["duck"])

# Operator actions on the same arrival order.
PUSHES = "select concat('agent-', user_id) as agent_id, event_id as seq, concat('cfg ', event_id % 4) as content from {events} where event_type in ('click', 'signup')"
PACKAGE_PUSHES = """select concat('agent-', user_id) as agent_id, event_id as seq, 'collector' as name, concat('0.', event_id % 12) as version,
    concat('hash', event_id % 12) as hash from {events} where event_type in ('click', 'view')"""
DELETES = "select concat('agent-', user_id) as agent_id, event_id as seq from {events} where event_type = 'error' and value > 60"


def messages(spark, sf):
    """The log in its declared shape, absent parts as NULL structs."""
    flat = run_sql(spark, sf, SPARK_MESSAGES)
    status = lambda kind: F.when(F.col(f"{kind}_status").isNotNull(), F.struct(
        F.col(f"{kind}_status").alias("status"), F.col(f"{kind}_error").alias("error"))).alias(f"{kind}_status")
    shaped = flat.select(
        "agent_id", "seq", "ts",
        F.when(F.col("hostname").isNotNull(), F.struct("hostname", "service_version", "local_ui_addr")).alias("description"),
        F.when(F.col("healthy").isNotNull(), F.struct((F.col("healthy") == 1).alias("healthy"), "last_error")).alias("health"),
        "snapshot_json", "started_at", "effective_config", status("config"), status("package"))
    return shaped.to(AGENT_MESSAGE)


_LATEST = "max_by({0}, seq) filter ({0} is not null)"
_INVENTORY = f"""select agent_id, coalesce({_LATEST.format('hostname')}, '') as hostname, coalesce({_LATEST.format('service_version')}, '') as service_version,
    coalesce(max_by(coalesce(local_ui_addr, ''), seq) filter (hostname is not null), '') as local_ui_addr,
    epoch(date_trunc('second', max(ts)))::bigint as last_seen, coalesce({_LATEST.format('healthy')}, 1)::integer as healthy,
    coalesce({_LATEST.format('last_error')}, '') as last_error, coalesce({_LATEST.format('snapshot_json')}, '') as snapshot_json,
    coalesce({_LATEST.format('started_at')}, '') as last_started_at,
    coalesce(sha256({_LATEST.format('effective_config')}), '') as effective_config_hash from ({{source}}) group by 1"""


def _shown(inv):
    return inv.withColumns({"last_seen": F.unix_seconds("last_seen"), "healthy": F.col("healthy").cast("int")})


@query(_INVENTORY.format(source=DUCK))
def inventory(spark, sf):
    return _shown(f.inventory(messages(spark, sf)))


@query(_INVENTORY.format(source=f"select * from ({DUCK}) where ts <= timestamp '2024-01-15 12:00:00'"))
def inventory_asof(spark, sf):
    return _shown(f.inventory(messages(spark, sf), asof=F.lit("2024-01-15T12:00:00Z").cast("timestamp")))


_LAST_DELETE = f"select agent_id, max(seq) as deleted from ({DELETES}) group by 1"
_ALIVE = f"select m.* from ({DUCK}) m left join ({_LAST_DELETE}) d using (agent_id) where deleted is null or seq > deleted"


@query(_INVENTORY.format(source=_ALIVE))
def inventory_after_deletes(spark, sf):
    return _shown(f.inventory(messages(spark, sf), deletes=run_sql(spark, sf, DELETES)))


@query(f"""select agent_id, incarnation, min(seq) as first_seq, max(seq) as last_seq, count(*) as messages from (
    select agent_id, seq, d, sum(d) over (partition by agent_id order by seq, d) as incarnation from (
        select agent_id, seq * 2 as seq, 0 as d from ({DUCK}) union all select agent_id, seq * 2 + 1, 1 from ({DELETES}))) where d = 0 group by 1, 2""")
def incarnations(spark, sf):
    m = messages(spark, sf).select("agent_id", (F.col("seq") * 2).alias("seq"), "ts")
    d = run_sql(spark, sf, DELETES).withColumn("seq", F.col("seq") * 2 + 1)
    return f.incarnations(m, d, span=5_000)


# Half of the agents only ever appear as the target of an action.
_ACTIONS = "select concat('agent-', user_id + 1000000 * (event_id % 2)) as agent_id, event_id as seq, {ts} as ts from {{events}} where event_type = 'click'"


@query(f"""with m as (select agent_id, max(ts) as seen from ({DUCK}) group by 1),
    a as (select agent_id, min_by(ts, seq) as created from ({_ACTIONS.format(ts='ts')}) group by 1)
    select agent_id, epoch(date_trunc('second', coalesce(seen, created)))::bigint as last_seen from m full join a using (agent_id)""")
def last_seen(spark, sf):
    actions = run_sql(spark, sf, _ACTIONS.format(ts=_US["spark"]))
    return f.inventory(messages(spark, sf), actions=actions).select("agent_id", F.unix_seconds("last_seen").alias("last_seen"))


_RESTARTS = f"""select agent_id, seq, ts, started_at from (select *, lag(started_at) over (partition by agent_id order by seq) as before
    from ({DUCK}) where started_at is not null) where before <> started_at"""


@query(f"select agent_id, seq, started_at from ({_RESTARTS})")
def restarts(spark, sf):
    return f.restarts(messages(spark, sf), span=20_000).select("agent_id", "seq", "started_at")


@query(f"select agent_id, seq, started_at from ({_RESTARTS})")
def snapshot_restarts(spark, sf):
    """Restarts from a log that tells start times in its snapshots only."""
    log = f.with_started_at(messages(spark, sf).drop("started_at"))
    return f.restarts(log, span=20_000).select("agent_id", "seq", "started_at")


_HISTORY = f"""select agent_id, list(started_at order by seq) as h from (select *, row_number() over (partition by agent_id order by seq desc) as rn from ({_RESTARTS}))
    where rn <= {f.MAX_RESTART_HISTORY} group by 1"""


@query(f"select agent_id, array_to_string(h, ',') as restart_history from ({_HISTORY})")
def restart_history(spark, sf):
    out = f.restart_history(f.restarts(messages(spark, sf)))
    return out.withColumn("restart_history", F.array_join("restart_history", ","))


_ASOF = f"(select max(started_at) from ({DUCK}))"
_FLAP = f"""select agent_id, sum((t::timestamptz > cut::timestamptz - interval {f.FLAP_WINDOW_SECONDS} seconds)::integer) as restart_count_recent
    from (select agent_id, unnest(h) as t, {_ASOF} as cut from ({_HISTORY})) group by 1"""


def _asof(spark, sf):
    """The latest start time in the log, as the moment of reading."""
    return F.to_timestamp(messages(spark, sf).agg(F.max("started_at").alias("t")).scalar())


@query(f"select agent_id, restart_count_recent::integer as restart_count_recent, (restart_count_recent >= {f.FLAP_THRESHOLD})::integer as flapping from ({_FLAP})")
def flapping(spark, sf):
    out = f.flapping(f.restart_history(f.restarts(messages(spark, sf))), _asof(spark, sf))
    return out.select("agent_id", "restart_count_recent", F.col("flapping").cast("int").alias("flapping"))


@query(f"""with r as (select agent_id, seq, started_at, epoch_us(started_at::timestamptz) as at_us from ({_RESTARTS}))
    select agent_id, seq, started_at, n as recent, (n >= {f.FLAP_THRESHOLD})::integer as flapping from (select *, count(*) over (partition by agent_id order by at_us
    range between {f.FLAP_WINDOW_SECONDS * 1_000_000 - 1} preceding and current row) as n from r)""")
def flap_episodes(spark, sf):
    out = f.flap_episodes(f.restarts(messages(spark, sf)))
    return out.select("agent_id", "seq", "started_at", "recent", F.col("flapping").cast("int").alias("flapping"))


@query(f"select agent_id, seq, sha256(effective_config) as hash from ({DUCK}) where effective_config is not null")
def config_hashes(spark, sf):
    m = messages(spark, sf).filter("effective_config is not null")
    return m.select("agent_id", "seq", f.config_hash(F.col("effective_config")).alias("hash"))


@query(f"""select agent_id, seq, sha256(effective_config) as hash from (select *, lag(effective_config) over (partition by agent_id order by seq) as before
    from ({DUCK}) where effective_config is not null) where before is distinct from effective_config""")
def config_changes(spark, sf):
    return f.config_changes(messages(spark, sf), span=20_000).select("agent_id", "seq", "hash")


def rollout_sql(pushes: str, outcomes: str, payload: str) -> str:
    """Pushes and outcomes grouped into segments that end with an outcome."""
    return f"""with e as (select agent_id, seq, 'push' as event, {payload} as payload, null as error from ({pushes})
        union all select agent_id, seq, event, null, error from ({outcomes}) where event is not null),
    seg as (select *, coalesce(sum((event <> 'push')::integer) over (partition by agent_id order by seq rows between unbounded preceding and 1 preceding), 0) as s from e),
    per as (select agent_id, s, max_by(payload, seq) filter (event = 'push') as pushed, max(event) filter (event <> 'push') as closed,
        max(error) filter (event = 'failed') as error from seg group by 1, 2),
    good as (select agent_id, max_by(pushed, s) as good from per where closed = 'applied' and pushed is not null group by 1),
    err as (select agent_id, max_by(case when closed = 'failed' then error else '' end, s) as error from per
        where closed = 'failed' or (closed = 'applied' and pushed is not null) group by 1),
    pend as (select agent_id, pushed as pending from per where closed is null and pushed is not null)
    select a.agent_id, coalesce(pending, '') as pending, coalesce(good, '') as good, coalesce(error, '') as error
    from (select distinct agent_id from e) a left join good using (agent_id) left join err using (agent_id) left join pend using (agent_id)"""


_CONFIG_OUT = f"select agent_id, seq, case config_status when 'APPLIED' then 'applied' when 'FAILED' then 'failed' end as event, config_error as error from ({DUCK})"
_PACKAGE_OUT = f"select agent_id, seq, case package_status when 'Installed' then 'applied' when 'InstallFailed' then 'failed' end as event, package_error as error from ({DUCK})"
_CONFIG = rollout_sql(PUSHES, _CONFIG_OUT, "content")
_PACKAGE = rollout_sql(PACKAGE_PUSHES, _PACKAGE_OUT, "concat(name, ' ', version, ' ', hash)")


def _config(spark, sf):
    return f.config_rollout(messages(spark, sf), run_sql(spark, sf, PUSHES), span=20_000)


@query(f"""select agent_id, pending as pending_config, case when pending = '' then '' else sha256(pending) end as pending_config_hash,
    good as last_known_good_config, case when good = '' then '' else sha256(good) end as last_known_good_hash, error as last_config_error from ({_CONFIG})""")
def config_rollout(spark, sf):
    return _config(spark, sf)


@query(f"select agent_id, pending, good, error from ({_PACKAGE})")
def package_rollout(spark, sf):
    out = f.package_rollout(messages(spark, sf), run_sql(spark, sf, PACKAGE_PUSHES), span=20_000)
    join = lambda p: F.trim(F.concat_ws(" ", *[f"{p}_package_{n}" for n in ("name", "version", "hash")]))
    return out.select("agent_id", join("pending").alias("pending"), join("last_known_good").alias("good"), F.col("last_package_error").alias("error"))


@query(f"select agent_id, good as content, sha256(good) as hash from ({_CONFIG}) where good <> ''")
def rollback_configs(spark, sf):
    return f.rollback_plan(_config(spark, sf), "config")


@query(f"select agent_id, split_part(good, ' ', 1) as name, split_part(good, ' ', 2) as version, split_part(good, ' ', 3) as hash from ({_PACKAGE}) where good <> ''")
def rollback_packages(spark, sf):
    return f.rollback_plan(f.package_rollout(messages(spark, sf), run_sql(spark, sf, PACKAGE_PUSHES)), "package")


_DRIFT = f"""select i.agent_id, i.hostname, i.healthy, (coalesce(good, '') <> '' and effective_config_hash <> '' and effective_config_hash <> sha256(good)
    and effective_config_hash <> case when pending = '' then '' else sha256(pending) end)::integer as config_drifted from ({_INVENTORY.format(source=DUCK)}) i left join ({_CONFIG}) c using (agent_id)"""


@query(f"select agent_id, coalesce(config_drifted, 0) as config_drifted from ({_DRIFT})")
def config_drift(spark, sf):
    state = f.inventory(messages(spark, sf)).join(_config(spark, sf), "agent_id", "left")
    return f.config_drift(state).select("agent_id", F.col("config_drifted").cast("int").alias("config_drifted"))


# --- packages: parts as uploads ---

UPLOADS = "select p_partkey as seq, p_brand as name, concat('v', p_size) as version, concat('h', p_partkey) as hash, 1700000000 + p_partkey * 7 % 5000 as uploaded_at from {part}"
_CATALOGUE = f"select name, version, max_by(hash, seq) as hash, max_by(uploaded_at, seq) as uploaded_at from ({UPLOADS}) group by 1, 2"


@query(_CATALOGUE)
def packages(spark, sf):
    return f.list_packages(f.packages(run_sql(spark, sf, UPLOADS)))


@query(f"select * from ({_CATALOGUE}) where name = 'Brand#7' and version = 'v5'")
def package_lookup(spark, sf):
    return f.get_package(f.packages(run_sql(spark, sf, UPLOADS)), "Brand#7", "v5")


_PKG_REQ = """select l_orderkey * 10 + l_linenumber as request, case when l_quantity > 48 then '' else concat('Brand#', l_suppkey % 30) end as name,
    concat('v', l_partkey % 60) as version from {lineitem}"""


@query(f"""select rejected, count(*) as requests, count(distinct hash) as hashes from (
    select case when r.name = '' then 'name and version must not be empty' when c.hash is null then 'unknown package version' end as rejected,
    c.hash from ({_PKG_REQ}) r left join ({_CATALOGUE}) c using (name, version)) group by 1""")
def package_push_checks(spark, sf):
    out = f.validate_package_pushes(run_sql(spark, sf, _PKG_REQ), f.packages(run_sql(spark, sf, UPLOADS)))
    per_hash = out.groupBy("rejected", "hash").agg(F.count("*").alias("n"))
    return per_hash.groupBy("rejected").agg(F.sum("n").alias("requests"), F.count("hash").alias("hashes"))


_CFG_REQ = "select event_id as seq, case event_id % 9 when 0 then '' when 1 then '   ' else props end as content from {events}"


@query(f"select seq, case when trim(content) = '' then 'config must not be empty' end as rejected from ({_CFG_REQ})")
def config_push_checks(spark, sf):
    return f.validate_config_pushes(run_sql(spark, sf, _CFG_REQ)).select("seq", "rejected")


# --- tags: customers as tag requests ---

_TAGS = "select c_custkey as seq, concat('agent-', c_custkey % 500) as agent_id, concat('  Seg:', c_mktsegment, ' |env:n', c_nationkey % 3, '||seg:', lower(c_mktsegment), case when c_custkey % 10 = 0 then '|a,b' else '' end, '|ENV:N', c_nationkey % 3) as raw from {customer}"
_CLEAN = f"""select seq, agent_id, rejected, case when rejected is null then t end as tags from (select *, list_filter(clean, lambda x: contains(x, ','))[1] as rejected,
    list_filter(clean, lambda x, i: list_position(clean, x) = i) as t from (select *, list_filter(list_transform(string_split(raw, '|'), lambda x: lower(trim(x))), lambda x: x <> '') as clean from ({_TAGS})))"""


def _tag_events(spark, sf):
    return f.normalize_tags(run_sql(spark, sf, _TAGS).withColumn("tags", F.split("raw", r"\|")))


@query(f"select seq, agent_id, rejected, array_to_string(tags, ',') as tags from ({_CLEAN})")
def normalized_tags(spark, sf):
    return _tag_events(spark, sf).select("seq", "agent_id", "rejected", F.array_join("tags", ",").alias("tags"))


_TAGGED = f"select agent_id, max_by(tags, seq) as tags from ({_CLEAN}) where tags is not null group by 1"


@query(f"select agent_id, array_to_string(tags, ',') as tags from ({_TAGGED})")
def tags_latest(spark, sf):
    return f.tags_latest(_tag_events(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query(f"select agent_id, array_to_string(tags, ',') as tags from ({_TAGGED}) where list_contains(tags, 'env:n1')")
def tags_by_filter(spark, sf):
    return f.by_tag(f.tags_latest(_tag_events(spark, sf)), "env:n1").withColumn("tags", F.array_join("tags", ","))


@query("""select conv_id, turn, array_to_string(list_filter(string_split(text, ','), lambda x: x <> ''), '|') as items from {conversations}""")
def csv_lists(spark, sf):
    df = run_sql(spark, sf, "select * from {conversations}")
    return df.select("conv_id", "turn", F.array_join(f.parse_csv_list(F.col("text")), "|").alias("items"))


_CONNECTED = f"select agent_id from ({DUCK}) group by 1 having max(case event_type when 'error' then seq else -1 end) < max(case event_type when 'view' then seq else -1 end)"


def _tagged_inventory(spark, sf):
    return f.inventory(messages(spark, sf)).join(f.tags_latest(_tag_events(spark, sf)), "agent_id", "left")


@query(f"""with matched as (select i.agent_id, i.hostname from ({_INVENTORY.format(source=DUCK)}) i join ({_TAGGED}) t using (agent_id) where list_contains(tags, 'env:n1'))
    select agent_id, hostname, case when c.agent_id is null then 'pending' else 'sent' end as status,
    case when c.agent_id is null then 'agent not connected' else '' end as error, (select count(*) from matched) as matched
    from matched left join (select agent_id from ({_CONNECTED})) c using (agent_id)""")
def bulk_plan(spark, sf):
    seen = messages(spark, sf).groupBy("agent_id").agg(
        F.max(F.when(F.col("health.healthy"), F.col("seq"))).alias("good"), F.max(F.when(~F.col("health.healthy"), F.col("seq"))).alias("bad"))
    connected = seen.filter(F.coalesce("bad", F.lit(-1)) < F.coalesce("good", F.lit(-1)))
    return f.bulk_plan(_tagged_inventory(spark, sf), "env:n1", connected)


@query(f"select agent_id, hostname, last_seen from ({_INVENTORY.format(source=DUCK)})")
def listed_agents(spark, sf):
    return f.list_agents(_shown(f.inventory(messages(spark, sf)))).select("agent_id", "hostname", "last_seen")


@query(_INVENTORY.format(source=DUCK).replace("group by 1", "where agent_id = 'agent-7' group by 1"))
def one_agent(spark, sf):
    return _shown(f.get_agent(f.inventory(messages(spark, sf)), "agent-7"))


@query(f"""select agent_id, greatest(0, round((epoch_us((select max(ts) from ({DUCK}))) - last_seen * 1000000) / 1000000.0))::bigint as stale_seconds from ({_INVENTORY.format(source=DUCK)})""")
def staleness(spark, sf):
    m = messages(spark, sf)
    return f.staleness(f.inventory(m), m.agg(F.max("ts").alias("ts")).scalar()).select("agent_id", "stale_seconds")


# --- totals from snapshots ---

def _section(section: str, *fields: str) -> str:
    # DuckDB's json_each lists the components of one section.
    return " union all ".join(f"""select agent_id, '{section}' as section, e.key as component, '{field}' as field, (e.value->>'$.{field}')::bigint as value
        from ({_INVENTORY.format(source=DUCK)}) i, json_each(case when snapshot_json = '' then '{{}}' else snapshot_json end, '$.{section}') e""" for field in fields)


COUNTERS = " union all ".join([
    _section("receivers", "events_in"),
    _section("pipelines", "events_in", "events_out", "events_dropped", "events_dead_lettered", "parse_errors"),
    _section("exporters", "events_in", "batches_sent", "batches_failed", "retries")])


def _counters(spark, sf):
    return f.snapshot_counters(f.inventory(messages(spark, sf)))


@query(COUNTERS)
def snapshot_counters(spark, sf):
    return _counters(spark, sf)


@query(f"select sum(value)::bigint as total from ({COUNTERS}) where section = 'receivers' and field = 'events_in'")
def fleet_total(spark, sf):
    return f.fleet_total(_counters(spark, sf), "receivers", "events_in")


def _total(section: str, field: str) -> str:
    return f"(select sum(value)::bigint from ({COUNTERS}) where section = '{section}' and field = '{field}')"


@query(f"""select count(*) as agents, count(*) filter (healthy = 1) as healthy, count(*) filter (healthy = 0) as unhealthy,
    (select count(*) from ({_FLAP}) where restart_count_recent >= {f.FLAP_THRESHOLD}) as flapping, coalesce(sum(config_drifted), 0)::bigint as config_drift,
    {_total('receivers', 'events_in')} as events_in, {_total('pipelines', 'events_dropped')} as events_dropped,
    {_total('pipelines', 'parse_errors')} as parse_errors, {_total('exporters', 'batches_failed')} as batches_failed from ({_DRIFT})""")
def fleet_overview(spark, sf):
    states = f.agent_states(messages(spark, sf), run_sql(spark, sf, PUSHES), _asof(spark, sf), span=20_000)
    return f.fleet_overview(f.config_drift(states))


@query(f"""select i.agent_id, i.hostname, i.last_seen, i.healthy, i.snapshot_json, i.last_started_at, i.effective_config_hash, coalesce(restart_count_recent, 0)::integer as restart_count_recent,
    coalesce(pending, '') as pending_config, coalesce(good, '') as last_known_good_config, coalesce(error, '') as last_config_error
    from ({_INVENTORY.format(source=DUCK)}) i left join ({_FLAP}) using (agent_id) left join ({_CONFIG}) using (agent_id)""")
def agent_states(spark, sf):
    """Inventory, flapping and config rollout out of one pass, in small chunks."""
    out = f.agent_states(messages(spark, sf), run_sql(spark, sf, PUSHES), _asof(spark, sf), span=500)
    return out.select(
        "agent_id", "hostname", F.unix_seconds("last_seen").alias("last_seen"), F.col("healthy").cast("int").alias("healthy"), "snapshot_json", "last_started_at",
        "effective_config_hash", "restart_count_recent", "pending_config", "last_known_good_config", "last_config_error")


@query(f"""select agent_id, round((snapshot_json->'process'->>'cpu_seconds')::double, 1) as cpu_seconds, round((snapshot_json->'process'->>'memory_rss_bytes')::double / 1048576, 1) as rss_mib,
    round((snapshot_json->'process'->>'heap_alloc_bytes')::double / 1048576, 1) as heap_mib from ({_INVENTORY.format(source=DUCK)}) where snapshot_json <> ''""")
def agent_stats(spark, sf):
    return f.agent_stats(f.inventory(messages(spark, sf)))


# The same snapshots with an error text at every other failing exporter.
_ERROR = """case when {c} % 4 = 1 then replace(snapshot_json, '"last_error":null', concat('"last_error":{{"message":"timeout ', {c}, '","at":"2024-01-01T00:00:00Z"}}')) else snapshot_json end"""
_ERRORS = _INVENTORY.format(source=f"select * replace ({_ERROR.format(c='seq')} as snapshot_json) from ({DUCK})")


def _with_errors(spark, sf):
    text = _ERROR.replace("{{", "{").replace("}}", "}").replace("{c}", "seq")
    return f.inventory(messages(spark, sf).withColumn("snapshot_json", F.expr(text)))


_PARTS = """select agent_id, s as section, e.key as component, e.value as v from (select agent_id, unnest(['receivers', 'pipelines', 'exporters']) as s, snapshot_json as j
    from ({source}) where snapshot_json <> '') x, json_each(x.j, '$.' || s) e"""
_FIELD = "(v->>'{0}')::bigint"
_PROBLEM = " or ".join(f"coalesce({_FIELD.format(c)}, 0) > 0" for c in ("events_dropped", "parse_errors", "batches_failed"))
_FIELDS = ("events_in", "events_out", "events_dropped", "events_dead_lettered", "parse_errors", "batches_sent", "batches_failed", "retries")


@query(f"""select agent_id, section, component, {', '.join(f'{_FIELD.format(c)} as {c}' for c in _FIELDS)}, v->'last_error'->>'message' as last_error,
    ({_PROBLEM})::integer as problem from ({_PARTS.format(source=_ERRORS)})""")
def agent_breakdown(spark, sf):
    """Every component of every agent with its counters, last error and flag."""
    return f.agent_breakdown(_with_errors(spark, sf)).withColumn("problem", F.col("problem").cast("int"))


@query(f"""select agent_id, section, component, concat_ws(',', case when {_FIELD.format('batches_failed')} > 0 then 'batches_failed' end,
    case when {_FIELD.format('events_dropped')} > 0 then 'events_dropped' end, case when {_FIELD.format('parse_errors')} > 0 then 'parse_errors' end) as problems,
    coalesce({_FIELD.format('batches_failed')}, 0) + coalesce({_FIELD.format('events_dropped')}, 0) + coalesce({_FIELD.format('parse_errors')}, 0) as affected,
    v->'last_error'->>'message' as last_error from ({_PARTS.format(source=_ERRORS)}) where {_PROBLEM}""")
def problem_texts(spark, sf):
    """Components in trouble with the text of an exporter's last error."""
    state = _with_errors(spark, sf)
    return problem_rows(f.snapshot_counters(state), errors=f.exporter_errors(state))


@query(f"""with h as (select agent_id, seq, healthy, last_error, lag(healthy) over (partition by agent_id order by seq) as before from ({DUCK}) where healthy is not null),
    c as (select *, lead(seq) over (partition by agent_id order by seq) as end_seq from h where before is null or before <> healthy)
    select agent_id, seq as start_seq, end_seq, last_error as error from c where healthy = 0""")
def health_timeline(spark, sf):
    return f.health_timeline(messages(spark, sf), span=20_000).select("agent_id", "start_seq", "end_seq", "error")


@query("""select c_custkey as id, c_name as hostname, '' as tags, c_acctbal as balance from {customer}
    union all select s_suppkey, s_name, concat('n', s_nationkey), s_acctbal from {supplier}""")
def aligned_schemas(spark, sf):
    """Rows stored before and after a column was added, brought to one shape."""
    from pyspark.sql import types as T

    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("hostname", T.StringType()),
                           T.StructField("tags", T.StringType()), T.StructField("balance", T.DoubleType())])
    old = run_sql(spark, sf, "select c_custkey as id, c_name as hostname, c_acctbal as balance from {customer}")
    new = run_sql(spark, sf, "select s_suppkey as id, s_name as hostname, concat('n', s_nationkey) as tags, s_acctbal as balance from {supplier}")
    return f.align_schema(old, target).unionByName(f.align_schema(new, target))
