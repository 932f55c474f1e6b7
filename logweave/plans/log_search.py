"""Log search queries over records made from documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps
from ..operators import log_index, logs
from ..operators.logs import CAPACITY
from ..functions.severity import NUMBER_NAMES
from ..session import shared_dir
from .registry import query, run_spread, run_sql

# Documents and conversation turns as records; conversations have no source.
DOCS = """select doc_id as seq, case doc_id % 5 when 0 then 'ERROR' when 1 then 'warning' when 2 then '' when 3 then 'Info' else 'FATAL2' end as severity_text,
    cast(doc_id % 25 as integer) as severity_number, text as body, lang as a1, source as a2, concat('host-', doc_id % 20) as r1 from {documents}
    union all select 1000000000 + conv_id * 100 + turn, case role when 'user' then 'debug' else '' end, cast(turn % 25 as integer), text, role, cast(null as string), concat('host-', conv_id % 20)
    from {conversations}"""
DOC_KEYS = ("lang", "source", "host.name")

EVENTS = """select event_id as seq, case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else '' end as severity_text, cast(event_id % 25 as integer) as severity_number,
    concat(event_type, ' by user ', user_id, ' after ', event_id) as body, event_type as a1, concat('u', user_id) as a2, concat('host-', user_id % 10) as r1 from {events}"""
EVENT_KEYS = ("event_type", "session_id", "host.name")


def records(spark, sf, sql, keys):
    flat = run_spread(spark, sf, sql)
    df = flat.select(
        "seq", "severity_text", "severity_number", "body",
        maps.present({keys[0]: F.col("a1"), keys[1]: F.col("a2")}).alias("attributes"),
        maps.present({keys[2]: F.col("r1")}).alias("resource"))
    return logs.severity_label(df)


def _label() -> str:
    arms = " ".join(f"when {i} then '{n}'" for i, n in enumerate(NUMBER_NAMES))
    return f"coalesce(nullif(severity_text, ''), case severity_number {arms} end)"


def labelled(sql: str) -> str:
    return f"select *, {_label()} as severity from ({sql})"


def _recent(sql: str) -> str:
    return f"select * from ({labelled(sql)}) order by seq desc limit {CAPACITY}"


def _hit(q: str, keys) -> str:
    values = " or ".join(f"contains(lower({c}), '{q}')" for c in ("body", "a1", "a2", "r1"))
    named = " or ".join(f"({c} is not null and contains('{k}', '{q}'))" for c, k in zip(("a1", "a2", "r1"), keys))
    return f"coalesce({values}, false) or coalesce(contains(lower(a2), '{q}'), false) or coalesce(contains(lower(r1), '{q}'), false) or {named}"


SHOWN = "seq, severity, body, a1, a2, r1"


def _shown(df, keys):
    a, r = F.col("attributes"), F.col("resource")
    return df.select("seq", "severity", "body", a[keys[0]].alias("a1"), a[keys[1]].alias("a2"), r[keys[2]].alias("r1"))


@query(f"select {SHOWN} from ({_recent(EVENTS)})")
def recent_records(spark, sf):
    return _shown(logs.recent_logs(records(spark, sf, EVENTS, EVENT_KEYS)), EVENT_KEYS)


@query(f"select {SHOWN} from ({_recent(EVENTS)}) where {_hit('purchase', EVENT_KEYS)}")
def recent_500_search(spark, sf):
    return _shown(logs.query_logs(records(spark, sf, EVENTS, EVENT_KEYS), q="Purchase"), EVENT_KEYS)


@query(f"""select {SHOWN} from ({_recent(EVENTS)}) where lower(severity) = 'error' and (a1 = 'error') and ({_hit('user 1', EVENT_KEYS)})""")
def recent_all_filters(spark, sf):
    view = logs.query_logs(records(spark, sf, EVENTS, EVENT_KEYS), q="USER 1", severity="Error", attr_key="event_type", attr_value="error")
    return _shown(view, EVENT_KEYS)


@query(f"""select {SHOWN} from ({labelled(EVENTS)}) where seq > (select max(event_id) from {{events}} where event_type = 'signup')""")
def since_last_clear(spark, sf):
    clears = run_sql(spark, sf, "select event_id as seq from {events} where event_type = 'signup'")
    return _shown(logs.since_last_clear(records(spark, sf, EVENTS, EVENT_KEYS), clears), EVENT_KEYS)


@query(f"select seq, length(body) as chars from ({DOCS}) where {_hit('host-1', DOC_KEYS)} or {_hit('tion the', DOC_KEYS)}")
def text_search(spark, sf):
    """Whole texts and all keys and values, not only the recent view."""
    df = records(spark, sf, DOCS, DOC_KEYS)
    return df.filter(logs.matches_text("host-1") | logs.matches_text("TION the")).select("seq", F.length("body").cast("bigint").alias("chars"))


@query(f"select seq, length(body) as chars from ({DOCS}) where {_hit('host-1', DOC_KEYS)} or {_hit('tion the', DOC_KEYS)}")
def indexed_search(spark, sf):
    """Records in many files, of which a search reads those that may hold the text."""
    root = shared_dir(spark)
    records(spark, sf, DOCS, DOC_KEYS).repartitionByRange(16, "seq").write.parquet(f"{root}/records")
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    found = log_index.search_stored(spark, f"{root}/records", f"{root}/index", "host-1").unionByName(log_index.search_stored(spark, f"{root}/records", f"{root}/index", "TION the"))
    return found.select("seq", F.length("body").cast("bigint").alias("chars")).distinct()


@query(f"select seq, severity from ({labelled(DOCS)}) where lower(severity) = 'warning'")
def by_severity(spark, sf):
    return logs.by_severity(records(spark, sf, DOCS, DOC_KEYS), "WARNING").select("seq", "severity")


@query(f"select seq, a2 as source from ({DOCS}) where coalesce(a2, '') = ''")
def correlate_missing(spark, sf):
    """A missing key reads as ''."""
    out = logs.correlate(records(spark, sf, DOCS, DOC_KEYS), "source", "")
    # The key is absent from resource too, so every record matches; keep those that lack it altogether.
    return out.filter(~F.map_contains_key("attributes", "source")).select("seq", F.col("attributes")["source"].alias("source"))


@query(f"select {SHOWN} from ({labelled(EVENTS)}) where a2 = 'u42' or r1 = 'u42'")
def correlate(spark, sf):
    return _shown(logs.correlate(records(spark, sf, EVENTS, EVENT_KEYS), "session_id", "u42"), EVENT_KEYS)


@query(f"select distinct severity from ({labelled(DOCS)}) where severity <> ''")
def known_severities(spark, sf):
    return logs.severities(records(spark, sf, DOCS, DOC_KEYS))


_CLASS = """case when contains(lower(severity), 'err') or contains(lower(severity), 'fatal') then 'error' when contains(lower(severity), 'warn') then 'warn'
    when contains(lower(severity), 'info') then 'info' when contains(lower(severity), 'debug') then 'debug' when contains(lower(severity), 'trace') then 'trace' else 'info' end"""


@query(f"select {_CLASS} as severity_class, severity, count(*) as records from ({labelled(DOCS)}) group by 1, 2")
def severity_classes(spark, sf):
    df = logs.severity_class(records(spark, sf, DOCS, DOC_KEYS))
    return df.groupBy("severity_class", "severity").agg(F.count("*").alias("records"))


@query(f"""with shown as (select *, row_number() over (order by seq desc) - 1 as position from ({_recent(EVENTS)})),
    e as (select * from shown where {_CLASS} = 'error')
    select seq, position, coalesce(lead(position) over (order by position), min(position) over ()) as next_position,
    coalesce(lag(position) over (order by position), max(position) over ()) as previous_position from e""")
def error_positions(spark, sf):
    out = logs.error_positions(records(spark, sf, EVENTS, EVENT_KEYS))
    return out.select("seq", *[F.col(c).cast("bigint").alias(c) for c in ("position", "next_position", "previous_position")])


@query(f"""select key, value, count(*) as records from (
    select '{DOC_KEYS[0]}' as key, a1 as value from ({DOCS}) union all select '{DOC_KEYS[1]}', a2 from ({DOCS}) union all select '{DOC_KEYS[2]}', r1 from ({DOCS}))
    where value is not null group by 1, 2""")
def facets(spark, sf):
    return logs.facets(records(spark, sf, DOCS, DOC_KEYS))


@query(f"select seq, severity from ({labelled(EVENTS)})")
def newest_first(spark, sf):
    return logs.newest_first(records(spark, sf, EVENTS, EVENT_KEYS)).select("seq", "severity")
