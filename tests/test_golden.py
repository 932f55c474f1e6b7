"""Worked examples with known numbers."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import configs, fleet, logs, metrics, routing, topology
from logweave.sources.scrapes import read_metric_scrapes


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def routes(spark, *defs):
    return spark.createDataFrame([("a", *d) for d in defs], "agent_id string, pipeline string, receivers array<string>, exporters array<string>")


def counts(spark, **n):
    return spark.createDataFrame([("a", k.replace("__", "/"), v) for k, v in n.items()] or [], "agent_id string, id string, n bigint")


SHARED = [("syslog", ["udp"], ["x", "y"]), ("syslog5424", ["rfc5424"], ["x", "y"]), ("files", ["app"], ["x", "y"])]


@pytest.mark.parametrize("defs,accepted,sent,failed,expected", [
    (SHARED, {"udp": 60, "rfc5424": 150}, {"x": 210, "y": 210}, {}, [("files", 0, 0, 0), ("syslog", 60, 120, 0), ("syslog5424", 150, 300, 0)]),
    ([("only", ["r"], ["x"])], {"r": 42}, {"x": 42}, {"x": 3}, [("only", 42, 42, 3)]),
    ([("p", ["r"], ["x"]), ("q", ["s"], ["x"])], {}, {"x": 100}, {}, [("p", 0, 50, 0), ("q", 0, 50, 0)]),
    ([("twice", ["r", "r"], ["x", "x"]), ("none", [], [])], {"r": 5}, {"x": 10}, {}, [("none", 0, 0, 0), ("twice", 10, 10, 0)]),
])
def test_attribution(spark, defs, accepted, sent, failed, expected):
    out = metrics.attribute_pipelines(routes(spark, *defs), counts(spark, **accepted), counts(spark, **sent), counts(spark, **failed))
    assert rows(out, "pipeline", "events_in", "events_out", "events_dropped") == expected


SCRAPE = """# HELP otelcol_receiver_accepted_log_records x
# TYPE otelcol_receiver_accepted_log_records counter

otelcol_receiver_accepted_log_records{receiver="syslog/tcp",transport="tcp"} 40
otelcol_receiver_accepted_log_records{receiver="syslog/tcp",transport="udp"} 2.9
otelcol_receiver_accepted_log_records{receiver="filelog/app",transport=""} 7
otelcol_receiver_accepted_log_records{transport="none"} 99
otelcol_exporter_sent_log_records{exporter="hec"} 40
otelcol_exporter_send_failed_log_records{exporter="hec"} 2
  otelcol_process_cpu_seconds 2.75
otelcol_process_cpu_seconds 9
otelcol_process_memory_rss 2.922496e+07
odd{le="a\\"b,c=\\"d\\""} +Inf
not a sample
bad{x="1"} 12d
bad 1e999
""".splitlines()


@pytest.fixture
def samples(spark):
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(SCRAPE)], "scrape_id string, line_no bigint, text string")
    return read_metric_scrapes(lines)


def test_scrape(samples):
    assert samples.count() == 10
    assert rows(metrics.sum_by_label(samples, metrics.ACCEPTED, "receiver"), "id", "n") == [("filelog/app", 7), ("syslog/tcp", 42)]
    assert rows(metrics.sum_by_label(samples, "missing", "receiver")) == []
    assert rows(metrics.process_usage(samples)) == [("s", 2.75, 29224960, 0)]
    assert rows(metrics.first_value_of(samples, "missing")) == [("s", 0.0)]
    odd = samples.filter("family = 'odd'").first()
    assert odd.value == float("inf") and odd.labels == {"le": 'a\\"b,c=\\"d\\"'}


def test_blank_scrape_gives_no_rows(spark):
    lines = spark.createDataFrame([("s", 1, ""), ("s", 2, "   "), ("s", 3, "# c")], "scrape_id string, line_no bigint, text string")
    assert read_metric_scrapes(lines).count() == 0


def test_exporter_counters(spark, samples):
    ids = spark.createDataFrame([("s", "hec"), ("s", "idle")], "scrape_id string, id string")
    assert rows(metrics.exporter_counters(samples, ids), "id", "events_in", "batches_sent", "batches_failed") == [("hec", 42, 40, 2), ("idle", 0, 0, 0)]


def test_deliveries(spark):
    df = spark.createDataFrame([("hec", 1, "success", 10, None, 1), ("hec", 2, "retry", 0, None, 2), ("hec", 3, "failure", 3, "boom", 3)],
                               "exporter string, seq bigint, kind string, batch_len bigint, message string, at bigint")
    assert rows(metrics.delivery_counters(df)) == [("hec", 13, 1, 1, 1, "boom", 3)]


# --- log search ---

@pytest.fixture
def records(spark):
    data = [
        (1, "ERROR", None, "link down", {"product": "cisco_asa", "session_id": "42"}, {"host.name": "web-01"}),
        (2, "info", None, "session 42 opened", {"product": "nginx"}, {}),
        (3, "", 17, "plain", {}, {"region": "eu"}),
    ]
    df = spark.createDataFrame(data, "seq bigint, severity_text string, severity_number int, body string, attributes map<string,string>, resource map<string,string>")
    return logs.severity_label(df)


@pytest.mark.parametrize("filters,expected", [
    ({}, [1, 2, 3]),
    ({"severity": "error"}, [1, 3]),
    ({"severity": "ERROR"}, [1, 3]),
    ({"q": "cisco"}, [1]),
    ({"q": "CISCO"}, [1]),
    ({"q": "region"}, [3]),
    ({"attr_key": "product", "attr_value": "cisco_asa"}, [1]),
    ({"attr_key": "host.name", "attr_value": "web-01"}, [1]),
    ({"attr_key": "session_id", "attr_value": "42"}, [1]),
    ({"attr_key": "session_id", "attr_value": ""}, [1, 2, 3]),
    ({"severity": "info", "attr_key": "product", "attr_value": "nginx"}, [2]),
    ({"severity": "error", "attr_key": "product", "attr_value": "nginx"}, []),
    ({"q": "down\x00product"}, []),
])
def test_search(records, filters, expected):
    assert [r.seq for r in logs.query_logs(records, **filters).collect()] == expected


def test_recent_keeps_the_newest(spark, records):
    assert [r.seq for r in logs.recent_logs(records, 2).collect()] == [2, 3]
    many = spark.range(-3000, 3000).withColumnRenamed("id", "seq")
    assert [r.seq for r in logs.recent_logs(many, 500).collect()] == list(range(2500, 3000))
    low = spark.range(-9000, -8000).withColumnRenamed("id", "seq")
    assert [r.seq for r in logs.recent_logs(low, 500).collect()] == list(range(-8500, -8000))
    sparse = spark.range(1000).select((F.col("id") * 100_000).alias("seq"))
    assert logs.recent_logs(sparse, 500).agg(F.min("seq"), F.count("*")).first() == (50_000_000, 500)


def test_filters_apply_to_the_recent_view(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") < 100, "ERROR").otherwise("INFO").alias("severity"))
    assert logs.query_logs(df, severity="error").count() == 0
    assert logs.query_logs(df, severity="error", n=None).count() == 100


def test_clear(spark, records):
    clears = spark.createDataFrame([(1,), (2,)], "seq bigint")
    assert [r.seq for r in logs.since_last_clear(records, clears).collect()] == [3]
    assert logs.since_last_clear(records, clears.limit(0)).count() == 3


def test_error_jumps_wrap(records):
    assert rows(logs.error_positions(records)) == [(1, 2, 0, 0), (3, 0, 2, 2)]


# --- configs ---

DOC = """{"exporters":{"hec/a":{"endpoint":"https://x","token":"abc"}},"receivers":{"file_log/app":{"TOKEN":"t","list":[{"password":"p","keep":"k"}]},"lonely":{}},
 "extensions":{"file_storage":{"directory":"${DIR}"}},
 "service":{"extensions":[],"pipelines":{"logs/app":{"receivers":["file_log/app","file_log/app"],"exporters":["hec/a","ghost"]},"test":{"receivers":[],"exporters":["hec/a"]}}}}"""


@pytest.fixture
def doc(spark):
    return spark.createDataFrame([("a", DOC), ("broken", "{not json")], "agent_id string, doc string")


def test_redaction(doc):
    got = {".".join(r.path): r.value for r in configs.redact(doc).collect()}
    assert got["exporters.hec/a.token"] == configs.REDACTED
    assert got["exporters.hec/a.endpoint"] == "https://x"
    assert got["receivers.file_log/app.TOKEN"] == configs.REDACTED
    assert got["receivers.file_log/app.list.[0].password"] == configs.REDACTED
    assert got["receivers.file_log/app.list.[0].keep"] == "k"
    assert got["extensions.file_storage.directory"] == "${DIR}"


def test_secret_report_and_placeholder(doc):
    leaves = configs.config_leaves(doc)
    assert sorted(r.value for r in configs.plaintext_secrets(leaves).collect()) == ["abc", "p", "t"]
    values = {r.value for r in configs.placeholder(leaves).collect()}
    assert configs.PLACEHOLDER in values and "${DIR}" not in values


def test_definitions(doc):
    components, defs = configs.explode_config(doc)
    assert rows(routing.pipelines_referencing(defs, "receiver", "file_log/app"), "pipeline") == [("logs/app",)]
    assert rows(routing.pipelines_referencing(defs, "extension", "file_storage")) == []
    stripped = routing.strip_from_pipelines(defs, "receiver", "file_log/app")
    assert rows(routing.pipelines_referencing(stripped, "receiver", "file_log/app")) == []
    assert rows(routing.derive_extensions(components)) == [("a", ["file_storage"])]
    audit = routing.config_audit(components, defs, configs.config_active_extensions(doc), configs.config_host_settings(doc))
    assert rows(audit, "rule", "subject") == [
        ("extension not activated", "file_storage"), ("no receivers", "test"), ("undefined component", "ghost"),
        ("unknown signal", "test"), ("unused component", "lonely")]
    nodes = topology.topology_nodes(components, defs)
    assert rows(nodes, "type", "id") == [("exporter", "hec/a"), ("pipeline", "logs/app"), ("pipeline", "test"), ("receiver", "file_log/app"), ("receiver", "lonely")]
    counters = nodes.sparkSession.createDataFrame([("a", "receivers", "file_log/app", "events_in", 4), ("a", "receivers", "file_log/app", "events_in", 6), ("b", "receivers", "x", "events_in", 1)],
                                                  "agent_id string, section string, component string, field string, value bigint")
    graphs = topology.agent_graphs(doc, counters, pipeline_volume=True)
    links = topology.graph_links(graphs)
    assert ("logs/app", "ghost") not in rows(links, "from", "to")
    # Listed twice: two links, and twice the volume of the pipeline.
    assert rows(links, "from", "to", "flow", "offset", "percent") == [
        ("file_log/app", "logs/app", 10, 0, 100), ("file_log/app", "logs/app", 10, 10, 100), ("logs/app", "hec/a", 20, 0, 200), ("test", "hec/a", 0, 20, 0)]
    assert rows(topology.graph_nodes(graphs), "type", "id", "flow", "rank") == [
        ("exporter", "hec/a", 0, 1), ("pipeline", "logs/app", 20, 1), ("pipeline", "test", 0, 2), ("receiver", "file_log/app", 10, 1), ("receiver", "lonely", 0, 2)]


def test_empty_graph(spark, doc):
    components, defs = configs.explode_config(doc.limit(0))
    assert topology.topology_nodes(components, defs).count() == 0
    counters = spark.createDataFrame([("a", "receivers", "r", "events_in", 1)], "agent_id string, section string, component string, field string, value bigint")
    nothing = spark.createDataFrame([("a", "{}"), ("b", "no JSON"), ("c", None), ("d", '{"service":{"pipelines":[]},"receivers":5}')], "agent_id string, doc string")
    for docs in (doc.limit(0), nothing):
        graphs = topology.agent_graphs(docs, counters)
        assert topology.graph_nodes(graphs).count() == topology.graph_links(graphs).count() == 0


# --- fleet ---

def test_tags(spark):
    agents = spark.createDataFrame([("1", ["env:staging"]), ("2", ["env:staging", "x"]), ("3", ["env:prod"]), ("4", ["env:prod", "env:staging-2"])], "agent_id string, tags array<string>")
    assert fleet.by_tag(agents, "env:staging").count() == 2
    assert fleet.by_tag(agents, "env:prod").count() == 2
    assert fleet.by_tag(agents, "none").count() == 0
    req = spark.createDataFrame([(1, "a", [" Env:Prod ", "", "env:prod", "B"]), (2, "a", ["c"]), (3, "a", ["x,y"])], "seq bigint, agent_id string, tags array<string>")
    clean = fleet.normalize_tags(req)
    assert rows(clean, "seq", "tags", "rejected") == [(1, ["env:prod", "b"], None), (2, ["c"], None), (3, None, "x,y")]
    assert rows(fleet.tags_latest(clean)) == [("a", ["c"])]
    parsed = spark.createDataFrame([("",), ("a,b",), (",a,,",), (None,)], "t string").select(fleet.parse_csv_list(F.col("t")).alias("x"))
    assert [r.x for r in parsed.collect()] == [[], ["a", "b"], ["a"], []]


def started(spark, *times, agent="a"):
    return spark.createDataFrame([(agent, i, None, t) for i, t in enumerate(times)], "agent_id string, seq bigint, ts timestamp, started_at string")


def test_restarts(spark):
    assert fleet.restarts(started(spark, "t0")).count() == 0
    assert fleet.restarts(started(spark, "t0", "t0", None, "", "t0")).count() == 0
    assert rows(fleet.restarts(started(spark, "2026-01-01T00:00:00Z", "2026-01-01T00:05:00Z")), "started_at") == [("2026-01-01T00:05:00Z",)]
    many = fleet.restart_history(fleet.restarts(started(spark, *[f"t{i}" for i in range(13)])))
    assert many.first().restart_history == [f"t{i}" for i in range(3, 13)]


def test_flapping(spark):
    log = started(spark, *[f"2026-01-01T00:{m:02d}:00Z" for m in (51, 53, 55, 57)], agent="f").unionByName(
        started(spark, "2026-01-01T00:00:00Z", "2026-01-01T00:50:00Z", "junk", agent="edge"))
    out = fleet.flapping(fleet.restart_history(fleet.restarts(log)), F.lit("2026-01-01T01:00:00Z").cast("timestamp"))
    assert rows(out, "agent_id", "restart_count_recent", "flapping") == [("edge", 0, False), ("f", 3, True)]


@pytest.mark.parametrize("good,pending,running,drifted", [
    ("", "", "e", False), ("e", "", "e", False), ("g", "e", "e", False), ("g", "p", "e", True), ("g", "", "", False), ("g", None, "e", True)])
def test_drift(spark, good, pending, running, drifted):
    df = spark.createDataFrame([(good, pending, running)], "last_known_good_hash string, pending_config_hash string, effective_config_hash string")
    assert fleet.config_drift(df).first().config_drifted is drifted


def statuses(spark, kind, *items):
    return spark.createDataFrame([("a", seq, (status, error)) for seq, status, error in items], f"agent_id string, seq bigint, {kind} struct<status:string,error:string>")


def test_package_lifecycle(spark):
    pushes = spark.createDataFrame([("a", 1, "c", "0.1.1", "hash1"), ("a", 3, "c", "0.1.2", "hash2")], "agent_id string, seq bigint, name string, version string, hash string")
    before = fleet.package_rollout(statuses(spark, "package_status", (2, "Installed", None)), pushes).first()
    assert (before.pending_package_version, before.last_known_good_package_version) == ("0.1.2", "0.1.1")
    after = fleet.package_rollout(statuses(spark, "package_status", (2, "Installed", None), (4, "InstallFailed", "boom: exec failed")), pushes).first()
    assert (after.pending_package_version, after.last_known_good_package_hash, after.last_package_error) == ("", "hash1", "boom: exec failed")


def test_applied_with_nothing_pending_is_ignored(spark):
    pushes = spark.createDataFrame([("a", 1, "cfg")], "agent_id string, seq bigint, content string")
    out = fleet.config_rollout(statuses(spark, "config_status", (2, "APPLIED", None), (3, "APPLIED", None)), pushes).first()
    assert out.last_known_good_config == "cfg" and out.pending_config == ""


def test_old_rows_take_the_new_shape(spark):
    from pyspark.sql import types as T
    target = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.StringType()), T.StructField("n", T.LongType())])
    once = fleet.align_schema(spark.createDataFrame([("1",)], "id string"), target)
    assert rows(once) == [("1", "", None)] and rows(fleet.align_schema(once, target)) == [("1", "", None)]
    assert once.schema == fleet.align_schema(spark.createDataFrame([("1", "t", 2)], "id string, tags string, n bigint"), target).schema
