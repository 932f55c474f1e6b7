"""Cases in which lines, restarts or deletes used to be lost."""

import time

import pytest
from pyspark.sql import functions as F

from logweave.operators import configs
from logweave.operators.chain import Chain, kv_parts
from logweave.operators.fleet import inventory
from logweave.operators.joins import join_dimension
from logweave.operators.syslog import envelope, structured_data
from logweave.session import newest_version, shared_dir
from logweave.sources.files import read_log_files
from logweave.sources.frames import split_octet_frames
from logweave.streaming import fleet as live
from logweave.streaming.delivery import envelopes, recent_stream

MANY = 20_000


def test_structured_data_of_any_length(spark):
    sd = "[id " + " ".join(f'k{i}="v\\"{i}"' for i in range(MANY)) + "]"
    line = f"<13>1 2024-01-01T00:00:00Z h a p m {sd} text"
    df = spark.createDataFrame([(line,)], "body string")
    chain = Chain(df)
    envelope(chain, "rfc5424")
    assert chain.records().select(F.col("attributes")["content"]).first()[0] == "text"
    assert len(spark.createDataFrame([(sd,)], "t string").select(structured_data(F.col("t"))).first()[0]) > MANY


def test_tokens_of_any_length(spark):
    df = spark.createDataFrame([("k=" + '"a b"c' * MANY + " z=1",)], "t string")
    parts = df.select(kv_parts(F.col("t")).alias("p")).first()["p"]
    assert parts["keys"] == ["k", "z"] and len(parts["values"][0]) == 4 * MANY
    parts = df.select(kv_parts(F.col("t"), "=", ";").alias("p")).first()["p"]
    assert parts["keys"] == ["k"]


def test_a_stream_resumes_where_it_began(spark):
    root = shared_dir(spark)

    def put(n):
        spark.createDataFrame([(f"line {n}",)], "value string").coalesce(1).write.mode("append").text(f"{root}/in")

    def run():
        lines = read_log_files(spark, [f"{root}/in"], stream=True, checkpoint=f"{root}/cp")
        lines.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.body for r in spark.read.parquet(f"{root}/out").collect())

    put(0)
    time.sleep(1.1)
    assert run() == []
    time.sleep(1.1)
    put(1)
    assert run() == ["line 1"]
    put(2)
    assert run() == ["line 1", "line 2"]
    with pytest.raises(ValueError):
        read_log_files(spark, [f"{root}/in"], stream=True)


def test_a_pattern_without_files_adds_no_lines(spark):
    root = shared_dir(spark)
    spark.createDataFrame([("x",)], "value string").write.text(f"{root}/in")
    assert read_log_files(spark, [f"{root}/none/*.log", f"{root}/in"], start_at="beginning").count() == 1


def test_exporter_types(spark):
    records = spark.createDataFrame([(1, "syslog/r", "b")], "seq long, receiver string, body string").selectExpr(
        "*", "current_timestamp() as ts", "cast(null as string) severity_text", "cast(null as int) severity_number", "map('a','b') attributes", "map('a','b') resource")
    routes = lambda *e: spark.createDataFrame([("logs", ["syslog/r"], list(e))], "pipeline string, receivers array<string>, exporters array<string>")
    out = envelopes(records, routes("splunk_hec/x", "hec", "dataset/y", "debug"))
    assert out.where("value is not null").count() == 4
    with pytest.raises(Exception, match="no envelope"):
        envelopes(records, routes("kafka/x")).collect()


def test_salt_of_records_with_maps_follows_the_row(spark):
    fact = spark.range(3000).selectExpr("id % 2 as k", "map('a', cast(id as string)) as m")
    dim = spark.range(2).selectExpr("id as k", "id * 10 as v")
    out = join_dimension(fact, dim, ["k"], size=1)
    assert "rand" not in out._jdf.queryExecution().toString() and out.count() == 3000


def test_deletes_after_asof_do_not_count(spark):
    messages = spark.createDataFrame([("a", 1, 10)], "agent_id string, seq long, t long").selectExpr(
        "agent_id", "seq", "timestamp_seconds(t) as ts", "named_struct('hostname','h','service_version','1','local_ui_addr','u') as description",
        "named_struct('healthy', true, 'last_error', '') as health", "'{}' as snapshot_json", "'s' as started_at", "'c' as effective_config")
    deletes = spark.createDataFrame([("a", 5, 50)], "agent_id string, seq long, t long").selectExpr("agent_id", "seq", "timestamp_seconds(t) as ts")
    at = lambda t: inventory(messages, asof=F.timestamp_seconds(F.lit(t)), deletes=deletes).count()
    assert (at(20), at(60)) == (1, 0)


def test_documents_of_any_depth(spark):
    texts = ['{"a":' * n + '"x [{"' + "}" * n for n in (1, 3, 30)]
    docs = spark.createDataFrame([(str(i), t.replace('"x [{"', '"x [{ \\" "')) for i, t in enumerate([*texts, "[]", "5", "{"])], "agent_id string, doc string")
    assert sorted((r.agent_id, len(r.path)) for r in configs.config_leaves(docs).collect()) == [("0", 1), ("1", 3), ("2", 30), ("3", 0), ("4", 0)]


def test_old_versions_go(spark):
    root = shared_dir(spark)
    shape = "seq long, ts timestamp, severity_text string, severity_number int, body string, attributes map<string,string>, resource map<string,string>"
    for i in range(4):
        spark.createDataFrame([(i, None, None, None, "b", None, None)], shape).write.mode("append").parquet(f"{root}/in")
        recent_stream(spark.readStream.schema(shape).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp", n=3).awaitTermination()
    assert sorted(r.seq for r in newest_version(spark, f"{root}/out").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{root}/out").select("version").distinct().count() == 2


def test_reports_wait_for_whole_scrapes(spark):
    root = shared_dir(spark)
    shape = "agent_id string, scrape_id long, lines long, line_no long, text string, error string, started_at string, scraped_at timestamp"
    line = lambda agent, scrape, of, no, text, error=None: (agent, scrape, of, no, text, error, "2024-01-01T00:00:00Z", None)
    sample = 'otelcol_receiver_accepted_log_records{receiver="r"} %d'
    routes = spark.createDataFrame([(a, "p", ["r"], ["x"]) for a in "ab"], "agent_id string, pipeline string, receivers array<string>, exporters array<string>")
    ids = lambda i: spark.createDataFrame([(a, i) for a in "ab"], "agent_id string, id string")
    seen = []
    for rows in ([line("a", 1, 2, 1, sample % 10), line("b", 1, 1, 1, sample % 7)], [line("a", 1, 2, 2, sample % 5)],
                 [line("a", 2, 1, 1, None, "refused"), line("b", 2, 2, 1, sample % 9)], [line("a", 3, 1, 1, sample % 20), line("b", 2, 2, 2, sample % 1)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(shape).parquet(f"{root}/in")
        live.report_stream(stream, routes, ids("r"), ids("x"), f"{root}/out", f"{root}/cp", every=None).awaitTermination()
        got = live.current_reports(spark, f"{root}/out").select("agent_id", "healthy", "last_error", F.get_json_object("snapshot_json", "$.receivers.r.events_in").alias("n"))
        seen.append(sorted(tuple(r) for r in got.collect()))
    assert seen == [[("b", True, "", "7")], [("a", True, "", "15"), ("b", True, "", "7")], [("a", False, "refused", "15"), ("b", True, "", "7")],
                    [("a", True, "", "20"), ("b", True, "", "10")]]
    graphs = live.current_reports(spark, f"{root}/out").select(F.get_json_object("snapshot_json", "$.topology")).distinct().collect()
    assert [r[0] for r in graphs] == ['{"nodes":[{"id":"r","type":"receiver"},{"id":"x","type":"exporter"},{"id":"p","type":"pipeline"}],'
                                      '"edges":[{"from":"r","to":"p"},{"from":"p","to":"x"}]}']


def test_a_payload_of_many_frames(spark):
    n = 100_000
    df = spark.range(1).select(F.concat(F.repeat(F.lit("9 message 1"), n), F.lit("7 tail")).alias("payload"))
    got = split_octet_frames(df).agg(F.count("message"), F.max("frame_no"), F.countDistinct("message"), F.min("message"), F.max("_leftover")).first()
    assert tuple(got) == (n, n - 1, 1, "message 1", "7 tail")


def test_delivered_times_add_up_to_more_than_a_long_holds(spark, tmp_path):
    import shutil
    from decimal import Decimal

    from logweave.plans.delivery import live_delivery
    late = 7 * 10**18  # microseconds: two of them are more than a long holds
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    few = events.limit(40).withColumns({"user_id": F.lit(0).cast(events.schema["user_id"].dataType), "event_type": F.lit("error"),
                                        "ts": F.timestamp_micros(F.lit(late)).cast(events.schema["ts"].dataType)})
    few.write.parquet(f"{tmp_path}/events.parquet")
    shutil.copy("/root/testdata/sf0.001/nation.parquet", f"{tmp_path}/nation.parquet")
    out = live_delivery(spark, str(tmp_path)).collect()
    sent = [r for r in out if r.exporter.startswith("splunk_hec/")]
    assert sent and all(r.us == Decimal(late) * r.events for r in sent)
    assert all(r.us is None for r in out if r not in sent)
