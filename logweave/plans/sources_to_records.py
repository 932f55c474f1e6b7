"""Parsing queries: raw lines -> structured records, one per source template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.regex import named
from ..functions.severity import NUMBER_NAMES, SYSLOG_NUMBERS
from ..operators import chain as ops
from ..operators.chain import apply_operators, parse_quality
from ..operators.syslog import normalize_syslog, syslog_mismatch_report
from ..operators.templates import LINE_PATTERNS, TEMPLATES, normalize, normalize_all, plan, templates_df
from .lines import LINES, RECEIVER, envelope_sql, lines_sql, mixed_sql, quote, regex_cols, template_sql
from .registry import query, run_spread, run_sql


def level_sql(expr: str) -> str:
    arms = " ".join(f"when {i} then {n}" for i, n in enumerate(SYSLOG_NUMBERS))
    return f"case cast({expr} as integer) {arms} end"


def name_sql(expr: str) -> str:
    arms = " ".join(f"when {i} then '{n}'" for i, n in enumerate(NUMBER_NAMES))
    return f"case {expr} {arms} end"


def _fields(key: str, *names: str) -> str:
    return ", ".join(f"case when ok then g.{n} end as {n}" for n in names)


def _simple(spark, sf, key, *names, **extra):
    fields = {n: f"attributes.{n}" for n in names} | extra | {"sourcetype": "attributes.sourcetype", "failed": "_parse_error"}
    out = normalize(run_spread(spark, sf, lines_sql(key)), key, fields, keep=("seq",), year=2024)
    return out.withColumn("failed", F.col("failed").cast("int"))


def _simple_sql(key, *names, extra=""):
    return (f"select seq, {_fields(key, *names)}{', ' + extra if extra else ''}, '{TEMPLATES[key].sourcetype}' as sourcetype, "
            f"cast(not ok as integer) as failed from ({template_sql(key)})")


_ASA = f"""select *, case when ok then {level_sql('g.severity')} when env_ok then {level_sql('pri % 8')} end as num,
    case when ok then g.message when env_ok then text else body end as body2 from ({template_sql('cisco_asa')})"""


@query(f"""select seq, case when ok then g.severity end as severity, case when ok then g.msgid end as msgid,
    cast(num as integer) as severity_number, {name_sql('num')} as severity_text, body2 as body,
    case when env_ok then h.hostname end as hostname, cast(not ok as integer) as failed from ({_ASA})""")
def asa_fields(spark, sf):
    out = normalize(run_spread(spark, sf, lines_sql("cisco_asa")), "cisco_asa", {
        "severity": "attributes.severity", "msgid": "attributes.msgid", "severity_number": "severity_number",
        "severity_text": "severity_text", "body": "body", "hostname": "attributes.hostname", "failed": "_parse_error",
    }, keep=("seq",), year=2024)
    return out.withColumn("failed", F.col("failed").cast("int"))


@query(f"""select {name_sql('num')} as severity_text, count(*) as events_in, count(*) as events_out, 0::bigint as events_dropped,
    count(*) filter (not ok) as parse_errors, count(*) filter (ok) as parsed,
    count(*) filter (ok) / count(*) as match_rate from ({_ASA}) group by 1""")
def asa_parse_quality(spark, sf):
    """Flagship: raw lines -> records -> parse quality by severity."""
    records = plan(run_spread(spark, sf, lines_sql("cisco_asa")), "cisco_asa", year=2024).records(keep_dropped=True)
    return parse_quality(records, "severity_text")


@query(f"""select coalesce({name_sql('num')}, 'UNSPECIFIED') as severity, count(*) as records,
    count(case when ok then g.msgid end) as with_msgid, sum(length(body2))::bigint as body_chars from ({_ASA}) group by 1""")
def asa_by_severity(spark, sf):
    flat = normalize(run_spread(spark, sf, lines_sql("cisco_asa")), "cisco_asa",
                     {"severity": "severity_text", "msgid": "attributes.msgid", "body": "body"}, year=2024)
    return flat.groupBy(F.coalesce("severity", F.lit("UNSPECIFIED")).alias("severity")).agg(
        F.count("*").alias("records"), F.count("msgid").alias("with_msgid"), F.sum(F.length("body")).alias("body_chars"))


@query(f"""select seq, case when ok then g.facility when env_ok then cast(floor(pri / 8) as integer)::varchar end as facility, case when ok then g.mnemonic end as mnemonic,
    cast(case when ok then {level_sql('g.severity')} when env_ok then {level_sql('pri % 8')} end as integer) as severity_number,
    case when ok then g.message when env_ok then text else body end as body, cast(not ok as integer) as failed
    from ({template_sql('cisco_catalyst')})""")
def catalyst_fields(spark, sf):
    out = normalize(run_spread(spark, sf, lines_sql("cisco_catalyst")), "cisco_catalyst", {
        "facility": "attributes.facility", "mnemonic": "attributes.mnemonic", "severity_number": "severity_number",
        "body": "body", "failed": "_parse_error"}, keep=("seq",), year=2024)
    return out.withColumn("failed", F.col("failed").cast("int"))


# A pair text is good when every token has a key before its '='.
_KV_TOKENS = r"""regexp_extract_all({}, '((?:[^"\s]|"[^"]*"?)+)', 1)"""


def _kv_sql(tokens: str, key: str) -> str:
    hit = f"list_filter({tokens}, lambda t: starts_with(t, '{key}='))"
    return f"replace(substr({hit}[-1], {len(key) + 2}), '\"', '')"


@query(f"""with t as (select *, {_KV_TOKENS.format("g.message")} as tokens from ({template_sql('cisco_meraki')})),
    k as (select *, ok and len(tokens) > 0 and len(list_filter(tokens, lambda t: strpos(t, '=') <= 1)) = 0 as kv_ok from t)
    select seq, case when ok then g.device end as device, case when ok then g.log_type end as log_type,
    case when kv_ok then {_kv_sql('tokens', 'src')} end as src, case when kv_ok then {_kv_sql('tokens', 'dst')} end as dst,
    case when kv_ok then {_kv_sql('tokens', 'note')} end as note, case when kv_ok then {_kv_sql('tokens', 'bytes')} end as bytes,
    case when ok then g.message else body end as body, cast(not kv_ok as integer) as failed from k""")
def meraki_kv(spark, sf):
    names = ("device", "log_type", "src", "dst", "note", "bytes")
    out = normalize(run_spread(spark, sf, lines_sql("cisco_meraki")), "cisco_meraki",
                    {n: f"attributes.{n}" for n in names} | {"body": "body", "failed": "_parse_error"}, keep=("seq",))
    return out.withColumn("failed", F.col("failed").cast("int"))


@query(f"""select seq, text as body, case when env_ok then h.hostname end as hostname, 'ubiquiti' as datasource,
    'ubiquiti_ts_parser' as sourcetype from ({template_sql('ubiquiti')})""")
def ubiquiti_tags(spark, sf):
    return normalize(run_spread(spark, sf, lines_sql("ubiquiti")), "ubiquiti", {
        "body": "body", "hostname": "attributes.hostname", "datasource": "attributes.datasource",
        "sourcetype": "attributes.sourcetype"}, keep=("seq",), year=2024)


_HAPROXY = ("client_ip", "client_port", "accept_date", "frontend", "backend", "server", "status_code", "bytes_read", "http_request")


@query(_simple_sql("haproxy", *_HAPROXY))
def haproxy_fields(spark, sf):
    return _simple(spark, sf, "haproxy", *_HAPROXY)


@query(f"""select backend, status_code, count(*) as requests, sum(try_cast(bytes_read as bigint))::bigint as bytes
    from ({_simple_sql("haproxy", *_HAPROXY)}) where failed = 0 group by 1, 2""")
def haproxy_status(spark, sf):
    flat = _simple(spark, sf, "haproxy", "backend", "status_code", "bytes_read").filter("failed = 0")
    return flat.groupBy("backend", "status_code").agg(
        F.count("*").alias("requests"), F.sum(F.col("bytes_read").try_cast("bigint")).alias("bytes"))


_CEF = ("cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "cef_severity", "extension")


@query(f"""with t as (select *, {_KV_TOKENS.format("g.extension")} as tokens from ({template_sql('cef')})),
    k as (select *, ok and len(tokens) > 0 and len(list_filter(tokens, lambda t: strpos(t, '=') <= 1)) = 0 as kv_ok from t)
    select seq, {_fields('cef', *_CEF)}, case when kv_ok then {_kv_sql('tokens', 'src')} end as src,
    case when kv_ok then {_kv_sql('tokens', 'act')} end as act, case when kv_ok then {_kv_sql('tokens', 'cnt')} end as cnt,
    'cef_ts_parser' as sourcetype, cast(not kv_ok as integer) as failed from k""")
def cef_extension(spark, sf):
    return _simple(spark, sf, "cef", *_CEF, "src", "act", "cnt")


_OLD = envelope_sql(lines_sql("cisco_asa"), "rfc3164")


@query(f"""select seq, cast(env_ok as integer) as matched, case when env_ok then cast(floor(pri / 8) as integer)::varchar end as facility,
    cast(case when env_ok then {level_sql('pri % 8')} end as integer) as severity_number,
    case when env_ok then h.hostname end as hostname, case when env_ok then h.content end as content, body,
    case when env_ok then epoch(strptime(concat('2024 ', regexp_replace(h.time, '\\s+', ' ', 'g')), '%Y %b %-d %H:%M:%S'))::bigint end as ts_seconds
    from ({_OLD})""")
def rfc3164_envelope(spark, sf):
    out = normalize_syslog(run_spread(spark, sf, lines_sql("cisco_asa")), "rfc3164", year=2024)
    a = F.col("attributes")
    return out.select("seq", F.col("envelope_matched").cast("int").alias("matched"), a["facility"].alias("facility"),
                      "severity_number", a["hostname"].alias("hostname"), a["content"].alias("content"), "body",
                      F.unix_seconds("ts").alias("ts_seconds"))


_NEW = envelope_sql(lines_sql("generic_syslog"), "rfc5424")
_SD_JSON = "concat('{\"meta@32473\":{\"user\":\"', regexp_extract(h.structured_data, 'user=\"([^\"]*)\"', 1), '\",\"size\":\"', regexp_extract(h.structured_data, 'size=\"([^\"]*)\"', 1), '\"}}')"


@query(f"""select seq, cast(env_ok as integer) as matched, cast(case when env_ok then {level_sql('pri % 8')} end as integer) as severity_number,
    case when env_ok then nullif(h.hostname, '-') end as hostname, case when env_ok then h.appname end as appname,
    case when env_ok then h.proc_id end as proc_id, case when env_ok then h.msg_id end as msg_id,
    case when env_ok and h.structured_data <> '-' then {_SD_JSON} end as structured_data,
    case when env_ok then h.content end as message, case when env_ok then epoch(try_cast(h.time as timestamp))::bigint end as ts_seconds
    from ({_NEW})""")
def rfc5424_envelope(spark, sf):
    out = normalize_syslog(run_spread(spark, sf, lines_sql("generic_syslog")), "rfc5424")
    a = F.col("attributes")
    names = ("hostname", "appname", "proc_id", "msg_id", "structured_data", "message")
    return out.select("seq", F.col("envelope_matched").cast("int").alias("matched"), "severity_number",
                      *[a[n].alias(n) for n in names], F.unix_seconds("ts").alias("ts_seconds"))


@query(f"""select seq, case when env_ok then h.content else body end as body, 'generic_rsyslog' as sourcetype,
    cast(not env_ok as integer) as failed from ({_NEW})""")
def generic_syslog_body(spark, sf):
    out = normalize(run_spread(spark, sf, lines_sql("generic_syslog")), "generic_syslog",
                    {"body": "body", "sourcetype": "attributes.sourcetype", "failed": "_parse_error"}, keep=("seq",))
    return out.withColumn("failed", F.col("failed").cast("int"))


_BARE = envelope_sql(lines_sql("cef"), "none")


@query(f"""select seq, cast(env_ok as integer) as matched, case when env_ok then pri::varchar end as priority,
    cast(case when env_ok then {level_sql('pri % 8')} end as integer) as severity_number, body from ({_BARE})""")
def bare_priority(spark, sf):
    out = normalize_syslog(run_spread(spark, sf, lines_sql("cef")), "none")
    return out.select("seq", F.col("envelope_matched").cast("int").alias("matched"),
                      F.col("attributes")["priority"].alias("priority"), "severity_number", "body")


_EITHER = (f"select event_id as seq, {RECEIVER} as receiver, case when (event_id + user_id) % 4 = 0 "
           f"then {LINES['cisco_asa']} else {LINES['generic_syslog']} end as body from {{events}}")
_T3 = envelope_sql(_EITHER, "rfc3164")
_T5 = envelope_sql(_EITHER, "rfc5424")


@query(f"""with c as (select a.receiver, count(*) as lines, count(*) filter (a.env_ok) as own, count(*) filter (b.env_ok) as other
    from ({_T3}) a join (select seq, env_ok from ({_T5})) b on a.seq = b.seq group by 1)
    select receiver, lines, lines - own as mismatched, (lines - own) / lines as mismatch_rate,
    case when other > own then 'rfc5424' else 'rfc3164' end as suggested_protocol from c""")
def syslog_mismatch(spark, sf):
    return syslog_mismatch_report(run_spread(spark, sf, _EITHER), "rfc3164")


@query(f"""select seq, body, 'generic' as sourcetype from ({lines_sql('file_log')})""")
def file_log_tags(spark, sf):
    return normalize(run_spread(spark, sf, lines_sql("file_log")), "file_log",
                     {"body": "body", "sourcetype": "attributes.sourcetype"}, keep=("seq",))


_JSON = f"select *, case when json_valid(body) then body end as js, coalesce(json_type(case when json_valid(body) then body end) = 'OBJECT', false) as ok from ({lines_sql('json_logs')})"


@query(f"""select seq, js->>'$.k' as k, js->>'$.user' as "user", js->>'$.nested' as nested, 'json' as sourcetype, cast(not ok as integer) as failed from ({_JSON})""")
def json_logs_k(spark, sf):
    return _simple(spark, sf, "json_logs", "k", "user", "nested")


_W3C = ("date", "time", "s_ip", "method", "uri_stem", "uri_query", "port", "username", "client_ip", "user_agent", "referer",
        "status", "substatus", "win32_status", "time_taken")


@query(_simple_sql("w3c_logs", *_W3C, extra="body"))
def w3c_fields(spark, sf):
    return _simple(spark, sf, "w3c_logs", *_W3C, body="body")


@query(f"""select status, count(*) as requests, sum(try_cast(time_taken as bigint))::bigint as time_taken
    from ({_simple_sql("w3c_logs", "status", "time_taken")}) group by 1""")
def w3c_status(spark, sf):
    flat = _simple(spark, sf, "w3c_logs", "status", "time_taken")
    return flat.groupBy("status").agg(F.count("*").alias("requests"), F.sum(F.col("time_taken").try_cast("bigint")).alias("time_taken"))


_NGINX = ("remote_addr", "remote_user", "time_local", "request", "status", "bytes_sent", "referer", "user_agent")


@query(_simple_sql("nginx", *_NGINX))
def nginx_fields(spark, sf):
    return _simple(spark, sf, "nginx", *_NGINX)


@query(f"""select status, user_agent, count(*) as requests, sum(try_cast(bytes_sent as bigint))::bigint as bytes
    from ({_simple_sql("nginx", *_NGINX)}) group by 1, 2""")
def nginx_status(spark, sf):
    flat = _simple(spark, sf, "nginx", "status", "user_agent", "bytes_sent")
    return flat.groupBy("status", "user_agent").agg(
        F.count("*").alias("requests"), F.sum(F.col("bytes_sent").try_cast("bigint")).alias("bytes"))


# Web access lines whose path comes from the crawled pages, one line per page and event of its bucket.
_WEB = ("select p.page_id as seq, 'web' as receiver, concat('10.0.0.', p.page_id % 250, ' - - [05/Jan/2024:00:00:00 +0000] \"GET ', "
        "p.url, ' HTTP/1.1\" ', 200 + p.page_id % 5 * 100, ' ', length(p.html), ' \"-\" \"bot/', p.page_id % 3, '\"') as body from {pages} p")


@query(f"""select seq, case when ok then g.request end as request, case when ok then g.status end as status,
    case when ok then g.bytes_sent end as bytes_sent, cast(not ok as integer) as failed from ({template_sql('nginx', _WEB)})""")
def nginx_page_requests(spark, sf):
    out = normalize(run_spread(spark, sf, _WEB), "nginx", {
        "request": "attributes.request", "status": "attributes.status", "bytes_sent": "attributes.bytes_sent",
        "failed": "_parse_error"}, keep=("seq",))
    return out.withColumn("failed", F.col("failed").cast("int"))


_DHCP = ("event_id", "date", "time", "description", "ip_address", "host_name", "mac_address", "rest")


@query(_simple_sql("windows_dhcp", *_DHCP))
def dhcp_events(spark, sf):
    return _simple(spark, sf, "windows_dhcp", *_DHCP)


_MYSQL = ("timestamp", "thread_id", "level", "error_code", "subsystem", "message")


@query(_simple_sql("mysql", *_MYSQL))
def mysql_fields(spark, sf):
    return _simple(spark, sf, "mysql", *_MYSQL)


@query(f"""select level, subsystem, count(*) as records from ({_simple_sql("mysql", *_MYSQL)}) group by 1, 2""")
def mysql_levels(spark, sf):
    return _simple(spark, sf, "mysql", "level", "subsystem").groupBy("level", "subsystem").agg(F.count("*").alias("records"))


_PG = ("timestamp", "pid", "level", "message")


@query(_simple_sql("postgresql", *_PG))
def postgres_fields(spark, sf):
    return _simple(spark, sf, "postgresql", *_PG)


@query(f"""select level, count(*) as records, count(distinct pid) as pids from ({_simple_sql("postgresql", *_PG)}) group by 1""")
def postgres_levels(spark, sf):
    return _simple(spark, sf, "postgresql", "level", "pid").groupBy("level").agg(
        F.count("*").alias("records"), F.countDistinct("pid").alias("pids"))


_MSSQL = ("date", "time", "spid", "message")


@query(_simple_sql("sql_server", *_MSSQL))
def sqlserver_spid(spark, sf):
    return _simple(spark, sf, "sql_server", *_MSSQL)


_KAFKA = ("timestamp", "level", "message", "logger")


@query(_simple_sql("kafka", *_KAFKA))
def kafka_fields(spark, sf):
    return _simple(spark, sf, "kafka", *_KAFKA)


@query(f"""select logger, level, count(*) as records from ({_simple_sql("kafka", *_KAFKA)}) group by 1, 2""")
def kafka_loggers(spark, sf):
    return _simple(spark, sf, "kafka", "logger", "level").groupBy("logger", "level").agg(F.count("*").alias("records"))


_HADOOP = ("timestamp", "level", "thread", "logger", "message")


@query(_simple_sql("hadoop", *_HADOOP))
def hadoop_levels(spark, sf):
    return _simple(spark, sf, "hadoop", *_HADOOP)


def _mixed_oracle() -> str:
    """Per template: lines, lines with an error, lines whose grammar matched, categories."""
    parts = []
    for key in TEMPLATES:
        rows = f"select * from ({mixed_sql()}) where source_key = '{key}'"
        t = TEMPLATES[key]
        sub = template_sql(key, rows)
        if t.kv_from:
            sub = f"select *, {_KV_TOKENS.format('g.' + t.kv_from)} as tokens from ({sub})"
            good = "ok and len(tokens) > 0 and len(list_filter(tokens, lambda t: strpos(t, '=') <= 1)) = 0"
        elif t.json:
            good = "coalesce(json_type(case when json_valid(body) then body end) = 'OBJECT', false)"
        elif key == "generic_syslog":
            good = "env_ok"
        else:
            good = "ok" if t.pattern else "true"
        shown = "body"
        if t.move_message:
            shown = ("case when ok then g.message " if t.pattern else "case when false then '' ") + (
                "when env_ok then text " if t.envelope != "none" else "") + "else body end"
        elif key == "ubiquiti":
            shown = "text"
        parts.append(f"""select '{key}' as source_key, {quote(t.category)} as category, '{t.default_id}' as default_id,
            count(*) as records, count(*) filter (not ({good})) as failed, sum(length({shown}))::bigint as body_chars from ({sub})""")
    return " union all ".join(parts)


@query(_mixed_oracle())
def mixed_sources(spark, sf):
    """All eighteen templates over one mixed table, with the catalogue joined on."""
    records = normalize_all(run_spread(spark, sf, mixed_sql()), year=2024)
    counts = records.groupBy("source_key").agg(
        F.count("*").alias("records"), F.count_if(F.size("_errors") > 0).alias("failed"),
        F.sum(F.length("body")).alias("body_chars"))
    catalogue = templates_df(spark).select(F.col("key").alias("source_key"), "category", "default_id")
    return counts.join(catalogue, "source_key").select("source_key", "category", "default_id", "records", "failed", "body_chars")


_PAIRS = {"cisco_meraki": ("src", "dst", "note", "bytes"), "cef": ("src", "act", "cnt")}


def _attributes_oracle() -> str:
    """Every attribute of every line: of the header, the line grammar, JSON or key=value text and the tags, the last of them wins."""
    parts = []
    for key, t in TEMPLATES.items():
        sub = template_sql(key, f"select * from ({mixed_sql()}) where source_key = '{key}'")
        found: list[tuple[str, str, int]] = []
        if t.envelope:
            header = {"priority": "pri::varchar", "facility": "cast(floor(pri / 8) as integer)::varchar", "content": "h.content"}
            if t.envelope == "rfc3164":
                header |= {"message": "h.content", "hostname": "h.hostname"}
            if t.envelope == "rfc5424":
                header |= {n: f"nullif(h.{n}, '-')" for n in ("hostname", "appname", "proc_id", "msg_id")}
                header |= {"message": "h.content", "version": "h.version", "structured_data": f"case when h.structured_data <> '-' then {_SD_JSON} end"}
            found += [(n, f"case when env_ok then {v} end", 1) for n, v in header.items()]
        if t.pattern:
            found += [(n, f"case when ok then g.{n} end", 2) for n in named(t.pattern).names]
        if t.kv_from:
            sub = f"select *, {_KV_TOKENS.format('g.' + t.kv_from)} as tokens from ({sub})"
            good = "ok and len(tokens) > 0 and len(list_filter(tokens, lambda t: strpos(t, '=') <= 1)) = 0"
            found += [(n, f"case when {good} then {_kv_sql('tokens', n)} end", 3) for n in _PAIRS[key]]
        if t.json:
            found += [(n, f"case when json_valid(body) then body end->>'$.{n}'", 3) for n in ("k", "user", "nested")]
        found += [(n, f"'{v}'", 4) for n, v in (("datasource", t.datasource), ("sourcetype", t.sourcetype)) if v]
        entries = ", ".join(f"{{'k': '{n}', 'v': {v}, 'r': {r}}}" for n, v, r in found if not (t.move_message and n == "message"))
        parts.append(f"select seq, unnest([{entries}]) as e from ({sub})")
    return f"select seq, e.k as key, max_by(e.v, e.r) as value from ({' union all '.join(parts)}) where e.v is not null group by 1, 2"


@query(_attributes_oracle())
def mixed_attributes(spark, sf):
    """All attributes of all lines of all eighteen sources."""
    records = normalize_all(run_spread(spark, sf, mixed_sql()), year=2024)
    return records.select("seq", F.explode("attributes").alias("key", "value"))


# --- single operators on their own ---

@query(f"""select event_id as seq, epoch(date_trunc('second', ts))::bigint as a_seconds, epoch(date_trunc('minute', ts))::bigint as b_seconds,
    epoch(date_trunc('second', ts))::bigint as c_seconds, case when event_id % 7 = 0 then null else epoch(date_trunc('day', ts))::bigint end as d_seconds,
    cast(event_id % 7 = 0 as integer) as failed from {{events}}""")
def time_parse_layouts(spark, sf):
    """strptime, gotime and epoch layouts; the last one meets broken text."""
    lines = run_sql(spark, sf, """select event_id as seq, concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z') as a,
        date_format(ts, 'dd/MMM/yyyy:HH:mm') as b,
        cast(datediff(ts, date'1970-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts) as string) as c,
        case when event_id % 7 = 0 then 'n/a' else date_format(ts, 'yyyyMMdd') end as d, '' as body from {events}""")
    records = lines.select("seq", "body", F.create_map(*[x for n in "abcd" for x in (F.lit(n), F.col(n))]).alias("attributes"))
    out = None
    cols = {}
    chain = ops.Chain(records)
    for name, kind, layout in (("a", "strptime", "%Y-%m-%dT%H:%M:%SZ"), ("b", "gotime", "02/Jan/2006:15:04"),
                               ("c", "epoch", "s"), ("d", "strptime", "%Y%m%d")):
        chain.replace(ts=F.lit(None).cast("timestamp"))
        chain.apply([ops.time_parse(f"attributes.{name}", kind, layout, on_error="send_quiet")])
        (cols[name],) = chain.stage(seconds=F.unix_seconds("ts"))
    return chain.df.select("seq", *[F.col(c).alias(f"{n}_seconds") for n, c in cols.items()], chain._failed().cast("int").alias("failed"))


@query(f"""select receiver, count(*) as events_in, count(*) filter (ok) as events_out, count(*) filter (not ok) as events_dropped,
    count(*) filter (not ok) as parse_errors, count(*) filter (ok) as parsed, count(*) filter (ok) / count(*) as match_rate
    from ({template_sql('nginx')}) group by 1""")
def on_error_drop(spark, sf):
    """``on_error: drop`` discards what does not parse; the counts still see it."""
    lines = run_spread(spark, sf, lines_sql("nginx"))
    kept = apply_operators(lines, [ops.regex_parse(LINE_PATTERNS["nginx"], on_error="drop")], keep_dropped=True)
    return parse_quality(kept, "receiver")


_CHAIN = [
    ops.json_parse(on_error="send_quiet"),
    ops.copy("attributes.k", "attributes.k_copy"),
    ops.move("attributes.user", "resource.user"),
    ops.add("attributes.team", "blue"),
    ops.remove("attributes.nested"),
    ops.remove("attributes.absent"),
]


@query(f"""select seq, js->>'$.k' as k, js->>'$.k' as k_copy, js->>'$.user' as user_moved, 0 as has_user, 0 as has_nested, 'blue' as team,
    case when ok then 3 else 1 end as n_attributes, case when ok then 1 else 5 end as n_errors from ({_JSON})""")
def field_edits(spark, sf):
    """add, remove, copy and move on data-driven keys."""
    out = apply_operators(run_spread(spark, sf, lines_sql("json_logs")), _CHAIN)
    a = F.col("attributes")
    return out.select(
        "seq", a["k"].alias("k"), a["k_copy"].alias("k_copy"), F.col("resource")["user"].alias("user_moved"),
        F.map_contains_key(a, "user").cast("int").alias("has_user"), F.map_contains_key(a, "nested").cast("int").alias("has_nested"),
        a["team"].alias("team"), F.size(a).alias("n_attributes"), F.size("_errors").alias("n_errors"))


_WORDS = "case event_id % 9 when 0 then 'warn' when 1 then 'ERROR2' when 2 then 'crit' when 3 then '3' when 4 then 'Notice' when 5 then '9' when 6 then 'info' when 7 then 'emerg' else event_type end"


@query(f"""with s as (select event_id as seq, {_WORDS} as word from {{events}}),
    n as (select *, case lower(word) when 'warn' then 13 when 'error2' then 18 when 'crit' then 18 when '3' then 17 when 'notice' then 10
      when 'info' then 9 when 'emerg' then 21 when 'error' then 17 end as num from s)
    select seq, word, cast(num as integer) as severity_number, {name_sql('num')} as severity_text, cast(num is null as integer) as failed from n""")
def severity_presets(spark, sf):
    words = run_sql(spark, sf, f"select event_id as seq, '' as body, map('severity', {_WORDS}) as attributes from {{events}}")
    chain = ops.Chain(words).apply([ops.severity_parse(on_error="send_quiet")])
    out = chain.flat({"word": "attributes.severity", "severity_number": "severity_number", "severity_text": "severity_text",
                      "failed": "_parse_error"}, keep=("seq",))
    return out.withColumn("failed", F.col("failed").cast("int"))


@query(f"""select event_id as seq, user_id::varchar as user_id, event_type, (event_id % 2 = 0)::varchar as even,
    concat('{{"n":', event_id % 10, '}}') as nested from {{events}}""")
def stringified_attributes(spark, sf):
    typed = run_sql(spark, sf, """select event_id as seq, named_struct('user_id', user_id, 'event_type', event_type,
        'even', event_id % 2 = 0, 'nested', named_struct('n', event_id % 10)) as attributes from {events}""")
    out = ops.stringify_attrs(typed)
    return out.select("seq", *[F.col("attributes")[n].alias(n) for n in ("user_id", "event_type", "even", "nested")])
