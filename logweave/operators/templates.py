"""Source-normalisation jobs: one template per log source, as data.

``normalize`` runs one template over its own table; ``normalize_all`` runs all
of them over a mixed table in one scan, picking the template per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, regex, severity
from . import chain as ops
from .chain import Chain, computed_once, kv_map, kv_ok, kv_parts
from .syslog import MAX_PRIORITY, PATTERNS, envelope, rfc3164_time, structured_data
from .syslog import header as syslog_header

# The line grammar of each source (RE2 syntax).
LINE_PATTERNS = {
    "cisco_asa": r"^%ASA-(?P<severity>\d)-(?P<msgid>\d+):\s*(?P<message>.*)$",
    "cisco_catalyst": r"^%(?P<facility>[A-Z0-9_]+)-(?P<severity>\d)-(?P<mnemonic>[A-Z0-9_]+):\s*(?P<message>.*)$",
    "cisco_meraki": r"^(?P<timestamp>\S+\s+\S+)\s+(?P<device>\S+)\s+(?P<log_type>\S+)\s+(?P<message>.*)$",
    "haproxy": r'^(?P<client_ip>[\d.:a-fA-F]+):(?P<client_port>\d+) \[(?P<accept_date>[^\]]+)\] (?P<frontend>\S+) (?P<backend>\S+)/(?P<server>\S+) \S+ (?P<status_code>\d+) (?P<bytes_read>\d+) \S+ \S+ \S+ \S+ \S+ "(?P<http_request>[^"]*)"$',
    "cef": r"^CEF:(?P<cef_version>\d)\|(?P<device_vendor>[^|]*)\|(?P<device_product>[^|]*)\|(?P<device_version>[^|]*)\|(?P<signature_id>[^|]*)\|(?P<name>[^|]*)\|(?P<cef_severity>[^|]*)\|(?P<extension>.*)$",
    "w3c_logs": r"^(?P<date>\S+) (?P<time>\S+) (?P<s_ip>\S+) (?P<method>\S+) (?P<uri_stem>\S+) (?P<uri_query>\S+) (?P<port>\S+) (?P<username>\S+) (?P<client_ip>\S+) (?P<user_agent>\S+) (?P<referer>\S+) (?P<status>\d+) (?P<substatus>\d+) (?P<win32_status>\d+) (?P<time_taken>\d+)$",
    "nginx": r'^(?P<remote_addr>\S+) - (?P<remote_user>\S+) \[(?P<time_local>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d+) (?P<bytes_sent>\d+) "(?P<referer>[^"]*)" "(?P<user_agent>[^"]*)"$',
    "windows_dhcp": r"^(?P<event_id>\d+),(?P<date>[^,]*),(?P<time>[^,]*),(?P<description>[^,]*),(?P<ip_address>[^,]*),(?P<host_name>[^,]*),(?P<mac_address>[^,]*),(?P<rest>.*)$",
    "mysql": r"^(?P<timestamp>\S+)\s+(?P<thread_id>\d+)\s+\[(?P<level>\w+)\]\s+\[(?P<error_code>[\w-]+)\]\s+\[(?P<subsystem>[\w.]+)\]\s+(?P<message>.*)$",
    "postgresql": r"^(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+ \w+) \[(?P<pid>\d+)\] (?P<level>\w+):\s+(?P<message>.*)$",
    "sql_server": r"^(?P<date>\d{4}-\d{2}-\d{2}) (?P<time>\d{2}:\d{2}:\d{2}\.\d+) (?P<spid>\S+)\s+(?P<message>.*)$",
    "kafka": r"^\[(?P<timestamp>[\d-]+ [\d:,]+)\]\s+(?P<level>\w+)\s+(?P<message>.*?)\s+\((?P<logger>[\w.$]+)\)$",
    "hadoop": r"^(?P<timestamp>[\d-]+ [\d:,]+)\s+(?P<level>\w+)\s+\[(?P<thread>[^\]]+)\]\s+(?P<logger>\S+):\s+(?P<message>.*)$",
}


@dataclass(frozen=True)
class Template:
    key: str
    title: str
    category: str
    receiver_type: str
    default_id: str
    envelope: str = ""          # rfc3164 | rfc5424 | none | '' for whole lines
    sourcetype: str = ""
    datasource: str = ""
    severity: bool = False      # severity digit captured by the line grammar
    kv_from: str = ""           # attribute holding key=value text
    json: bool = False
    move_message: bool = False  # message replaces the body

    @property
    def pattern(self) -> str | None:
        return LINE_PATTERNS.get(self.key)

    def operators(self, sourcetype: str | None = None) -> list[dict]:
        """The template's chain after the envelope, as operator specs."""
        quiet = {"on_error": "send_quiet"}
        specs = []
        if self.pattern:
            specs.append(ops.regex_parse(self.pattern, **quiet))
        if self.json:
            specs.append(ops.json_parse(**quiet))
        if self.severity:
            specs.append(ops.severity_parse(**quiet))
        if self.kv_from:
            specs.append(ops.kv_parse(f"attributes.{self.kv_from}", **quiet))
        if self.datasource:
            specs.append(ops.add("attributes.datasource", self.datasource))
        specs.append(ops.add("attributes.sourcetype", sourcetype or self.sourcetype))
        if self.move_message:
            specs.append(ops.move("attributes.message", "body"))
        return specs


# Categories, titles, ids and tags of the eighteen sources.
_NETWORK, _GENERIC, _WINDOWS, _DATABASE, _MESSAGING = (
    "Network & security devices", "Generic", "Windows / Active Directory", "Databases", "Messaging & big data")
TEMPLATES = {t.key: t for t in (
    Template("cisco_asa", "Cisco ASA (syslog)", _NETWORK, "syslog", "syslog/cisco_asa", "rfc3164",
             "cisco_asa_ts_parser", "cisco_asa", severity=True, move_message=True),
    Template("cisco_catalyst", "Cisco Catalyst / IOS (syslog)", _NETWORK, "syslog", "syslog/cisco_catalyst", "rfc3164",
             "cisco_catalyst_ts_parser", "cisco_ios", severity=True, move_message=True),
    Template("cisco_meraki", "Cisco Meraki (syslog)", _NETWORK, "syslog", "syslog/cisco_meraki", "none",
             "cisco_meraki_ts_parser", "cisco_meraki", kv_from="message", move_message=True),
    Template("ubiquiti", "Ubiquiti / UniFi (syslog)", _NETWORK, "syslog", "syslog/ubiquiti", "rfc3164",
             "ubiquiti_ts_parser", "ubiquiti"),
    Template("haproxy", "HAProxy (syslog)", _NETWORK, "syslog", "syslog/haproxy", "rfc3164",
             "haproxy_ts_parser", "haproxy"),
    Template("cef", "CEF -- Common Event Format (syslog)", _NETWORK, "syslog", "syslog/cef", "none",
             "cef_ts_parser", "cef", kv_from="extension"),
    Template("generic_syslog", "Generic syslog (RFC 5424)", _GENERIC, "syslog", "syslog/generic", "rfc5424",
             "generic_rsyslog", "generic_syslog", move_message=True),
    Template("file_log", "Generic file tailing", _GENERIC, "file_log", "file_log/app", sourcetype="generic"),
    Template("json_logs", "JSON logs", _GENERIC, "file_log", "file_log/json", sourcetype="json", json=True),
    Template("w3c_logs", "W3C / IIS extended log", _GENERIC, "file_log", "file_log/iis", sourcetype="iis_w3c"),
    Template("nginx", "nginx access log", _GENERIC, "file_log", "file_log/nginx", sourcetype="nginx_access"),
    Template("windows_dhcp", "Windows DHCP server log", _WINDOWS, "file_log", "file_log/windows_dhcp", sourcetype="windows_dhcp"),
    Template("active_directory", "Active Directory (Windows Event Log)", _WINDOWS, "windows_event_log",
             "windows_event_log/active_directory", sourcetype="windows_security", datasource="active_directory"),
    Template("mysql", "MySQL error log", _DATABASE, "file_log", "file_log/mysql", sourcetype="mysql_error"),
    Template("postgresql", "PostgreSQL log", _DATABASE, "file_log", "file_log/postgresql", sourcetype="postgresql"),
    Template("sql_server", "SQL Server error log", _DATABASE, "file_log", "file_log/sql_server", sourcetype="sql_server"),
    Template("kafka", "Kafka broker log", _MESSAGING, "file_log", "file_log/kafka", sourcetype="kafka"),
    Template("hadoop", "Hadoop daemon log", _MESSAGING, "file_log", "file_log/hadoop", sourcetype="hadoop"),
)}


def templates_df(spark: SparkSession) -> DataFrame:
    """The catalogue as a small dimension table."""
    rows = [(t.key, t.title, t.category, t.receiver_type, t.default_id) for t in TEMPLATES.values()]
    return spark.createDataFrame(rows, "key string, title string, category string, receiver_type string, default_id string")


def plan(df: DataFrame, key: str, sourcetype: str | None = None, year: int | None = None,
         reference: Column | None = None) -> Chain:
    """Chain of one template over raw lines in ``body``; see ``normalize``."""
    template = TEMPLATES[key]
    chain = Chain(df)
    if template.envelope:
        envelope(chain, template.envelope, year, reference)
        if key == "ubiquiti":
            chain.put("body", chain.get("attributes.content"))
    specs = template.operators(sourcetype)
    if template.envelope and template.pattern:
        # Vendor grammars start after the header where there is one.
        chain.attributes.static["_text"] = F.coalesce(chain.get("attributes.content"), F.col("body"))
        chain.apply([specs[0] | {"parse_from": "attributes._text"}])
        del chain.attributes.static["_text"]
        specs = specs[1:]
    return chain.apply(specs)


def normalize(df: DataFrame, key: str, fields: dict[str, str] | list[str] | None = None, keep: tuple[str, ...] = (),
              sourcetype: str | None = None, year: int | None = None, reference: Column | None = None) -> DataFrame:
    """Records of one source from a table (or stream) of raw lines in ``body``.

    ``fields`` (paths such as ``attributes.msgid``) returns plain columns
    instead of the full record; prefer it when the fields are known.
    """
    chain = plan(df, key, sourcetype, year, reference)
    return chain.records() if fields is None else chain.flat(fields, keep)


def steps(kind: str) -> dict[str, list[dict]]:
    """The operators of a kind in each template's chain that has any: the same
    table of steps that ``plan`` runs for one template."""
    found = {t.key: [s for s in t.operators() if s["type"] == kind] for t in TEMPLATES.values()}
    return {key: own for key, own in found.items() if own}


def _pick(key: Column, cases: dict[str, Column], default: Column) -> Column:
    """CASE on the template key; each row evaluates only its own branch."""
    out = None
    for name, value in cases.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return default if out is None else out.otherwise(default)


def normalize_all(df: DataFrame, key: str = "source_key", year: int | None = None, reference: Column | None = None) -> DataFrame:
    """All templates over one mixed table in a single scan.

    ``key`` names each row's template; rows of an unknown template pass through
    with an error. The templates share one shape (header, line grammar, JSON,
    key=value, tags), so each step is one CASE over the key. As in
    ``normalize``, maps and severity that the table brings are kept under what
    is parsed.
    """
    k = F.col(key)
    null_str = F.lit(None).cast("string")
    no_groups = F.lit(None).cast("array<string>")
    shape = {"ts": "timestamp", "severity_text": "string", "severity_number": "int", "attributes": maps.STRING_MAP, "resource": maps.STRING_MAP}
    own = [c for c in df.columns if c not in shape and c != "body"]
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in shape.items() if c not in df.columns})

    # 1. header
    heads = {p: syslog_header(p) for p in PATTERNS}
    by_head = {p: [t.key for t in TEMPLATES.values() if t.envelope == p] for p in heads}
    head = no_groups
    for p, keys in by_head.items():
        head = F.when(k.isin(keys), regex.capture(F.col("body"), heads[p])).otherwise(head)
    df = computed_once(df, "_head", head)
    part = lambda p, name: regex.group("_head", heads[p], name)
    pri = null_str
    for p, keys in by_head.items():
        pri = F.when(k.isin(keys) & regex.matched("_head", heads[p]), part(p, "pri")).otherwise(pri)
    df = df.withColumn("_pri", pri.cast("int"))
    ok = F.coalesce(F.col("_pri") <= MAX_PRIORITY, F.lit(False))
    five, three = k.isin(by_head["rfc5424"]), k.isin(by_head["rfc3164"])
    content = F.when(five, F.regexp_replace(part("rfc5424", "content"), "^\ufeff", "")).when(
        three, part("rfc3164", "content")).otherwise(part("none", "content"))
    time = F.when(five, F.try_to_timestamp(F.nullif(part("rfc5424", "time"), F.lit("-")))).when(
        three, rfc3164_time(part("rfc3164", "time"), year, reference))
    df = df.withColumns({"_ok": ok, "_content": F.when(ok, content), "ts": F.when(ok, F.coalesce(time, F.col("ts"))).otherwise(F.col("ts"))})

    # 2. line grammar
    lines = {key: regex.named(own[0]["regex"]) for key, own in steps("regex_parser").items()}
    df = df.withColumn("_text", F.coalesce(F.col("_content"), F.col("body")))
    df = computed_once(df, "_got", _pick(k, {n: regex.capture(F.col("_text"), p) for n, p in lines.items()}, no_groups))
    hit = _pick(k, {n: regex.matched("_got", p) for n, p in lines.items()}, F.lit(None).cast("boolean"))
    df = df.withColumn("_hit", hit)
    names = _pick(k, {n: F.array(*[F.lit(g) for g in p.names]) for n, p in lines.items()}, no_groups)
    parsed = F.when(F.col("_hit"), F.map_from_arrays(names, F.slice("_got", 2, F.size("_got") - 1)))
    df = df.withColumn("_parsed", F.coalesce(parsed, maps.empty()))

    # 3. header attributes, then the parsed ones over them
    dash = lambda name: F.when(five, F.nullif(part("rfc5424", name), F.lit("-")))
    header = maps.present({
        "priority": F.when(F.col("_ok"), F.col("_pri").cast("string")),
        "facility": F.when(F.col("_ok"), F.floor(F.col("_pri") / 8).cast("string")),
        "content": F.col("_content"),
        "message": F.when(three | five, F.col("_content")),
        "hostname": F.when(F.col("_ok"), F.when(three, part("rfc3164", "hostname")).otherwise(dash("hostname"))),
        "appname": F.when(F.col("_ok"), dash("appname")),
        "proc_id": F.when(F.col("_ok"), dash("proc_id")),
        "msg_id": F.when(F.col("_ok"), dash("msg_id")),
        "version": F.when(F.col("_ok") & five, part("rfc5424", "version")),
        "structured_data": F.when(F.col("_ok") & five, structured_data(part("rfc5424", "structured_data"))),
    })
    attrs = F.when(F.col("_ok"), maps.merge(header, F.col("_parsed"))).otherwise(F.col("_parsed"))
    df = computed_once(df, "_new", attrs)
    df = computed_once(df, "_attrs", F.when(F.size("attributes") > 0, maps.merge(F.col("attributes"), F.col("_new"))).otherwise(F.col("_new")))

    # 4. JSON and key=value text (one of them per template at most)
    attribute = lambda path: path.removeprefix("attributes.")
    kv_steps, json_keys = steps("key_value_parser"), list(steps("json_parser"))
    kv_keys = list(kv_steps)
    kv_text = _pick(k, {key: F.col("_attrs")[attribute(own[0]["parse_from"])] for key, own in kv_steps.items()}, null_str)
    df = computed_once(df, "_pairs", F.when(k.isin(kv_keys), kv_parts(kv_text)))
    df = computed_once(df, "_json", F.when(k.isin(json_keys), maps.from_json_object(F.col("body"))))
    pairs_ok = kv_ok(F.col("_pairs"))
    df = computed_once(df, "_more", F.when(pairs_ok, kv_map(F.col("_pairs"))).otherwise(F.col("_json")))
    df = computed_once(df, "_attributes", F.when(F.col("_more").isNotNull(), maps.merge(F.col("_attrs"), F.col("_more"))).otherwise(F.col("_attrs")))

    # 5. severity, tags, body
    level_keys = list(steps("severity_parser"))
    df = df.withColumn("_sev", F.when(k.isin(level_keys), severity.preset_number(F.col("_attributes")["severity"])))
    number = F.coalesce(F.col("_sev"), F.when(F.col("_ok"), severity.syslog_number((F.col("_pri") % 8).cast("int"))))
    tags = _pick(k, {key: F.create_map(*[F.lit(x) for add in own for x in (attribute(add["field"]), add["value"])]) for key, own in steps("add").items()}, maps.empty())
    moving = k.isin(list(steps("move")))
    message = F.when(moving, F.col("_attributes")["message"])
    body = F.coalesce(message, F.when(k == "ubiquiti", F.col("_content")), F.col("body"))
    attrs = F.when(moving, F.map_filter("_attributes", lambda a, _: a != "message")).otherwise(F.col("_attributes"))
    err = lambda op, why, cond: F.when(cond, F.struct(F.lit(op).alias("op"), F.lit(why).alias("reason")))
    errors = F.array_compact(F.array(
        err("template", "unknown template", ~F.coalesce(k.isin(list(TEMPLATES)), F.lit(False))),
        err("regex_parser", "regex does not match", F.col("_hit") == F.lit(False)),
        err("json_parser", "not a JSON object", k.isin(json_keys) & F.col("_json").isNull()),
        err("severity_parser", "unknown severity", k.isin(level_keys) & F.col("_sev").isNull()),
        err("key_value_parser", "not key=value text", k.isin(kv_keys) & ~pairs_ok),
        err("move", "attributes.message is missing", moving & message.isNull()),
    ))
    return df.select(
        *own, "ts",
        F.coalesce(severity.number_name(number), F.col("severity_text")).alias("severity_text"), F.coalesce(number, F.col("severity_number")).alias("severity_number"),
        body.alias("body"), maps.merge(attrs, tags).alias("attributes"), F.coalesce("resource", maps.empty()).alias("resource"),
        errors.alias("_errors"),
    )
