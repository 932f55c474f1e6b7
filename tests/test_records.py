"""Operator chains, templates and sources beyond the SQL oracles."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweave.functions import severity, timefmt
from logweave.operators import chain as ops
from logweave.operators.syslog import normalize_syslog
from logweave.operators.templates import TEMPLATES, normalize, normalize_all, plan, templates_df
from logweave.plans.lines import lines_sql, mixed_sql
from logweave.plans.registry import run_sql
from logweave.session import shared_dir
from logweave.sinks.envelopes import as_json, debug_sink, hec_columns, to_datalake, to_hec
from logweave.sources.files import glob_regex, read_log_files
from logweave.sources.frames import split_octet_frames

SF = "/root/testdata/sf0.001"


def body(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq bigint, body string")


def test_catalogue(spark):
    rows = templates_df(spark).collect()
    assert len(rows) == 18 and len({r.key for r in rows}) == 18 and len({r.default_id for r in rows}) == 18
    assert len({r.category for r in rows}) == 5
    assert all(r.default_id.startswith(r.receiver_type + "/") for r in rows)


@pytest.mark.parametrize("brought", [False, True])
def test_single_scan_equals_single_template(spark, brought):
    """normalize_all gives what normalize gives for each template, whatever maps
    and severity the table brings."""
    mixed = run_sql(spark, SF, mixed_sql())
    if brought:
        mixed = mixed.selectExpr("*", "map('own', 'a', 'datasource', 'b', 'url', 'c') as attributes", "map('host.name', 'h') as resource",
                                 "'WARN' as severity_text", "13 as severity_number")
    everything = normalize_all(mixed, year=2024)
    for key in TEMPLATES:
        one = normalize(mixed.filter(F.col("source_key") == key), key, year=2024)
        shape = lambda df: {r.seq: (r.ts, r.severity_text, r.severity_number, r.body, r.attributes, r.resource, sorted((e.op, e.reason) for e in r._errors))
                            for r in df.collect()}
        assert shape(everything.filter(F.col("source_key") == key)) == shape(one), key


def test_unknown_template_passes_through(spark):
    df = body(spark, "x").withColumn("source_key", F.lit("nope"))
    row = normalize_all(df).first()
    assert row.body == "x" and row._errors[0].op == "template"


@pytest.mark.parametrize("key", sorted(TEMPLATES))
def test_map_and_flat_agree_and_nothing_is_lost(spark, key):
    df = run_sql(spark, SF, lines_sql(key))
    records = normalize(df, key, year=2024)
    assert records.count() == df.count()
    names = sorted({k for r in records.select(F.map_keys("attributes").alias("k")).distinct().collect() for k in r.k})
    flat = normalize(df, key, {f"f_{n}": f"attributes.{n}" for n in names}, keep=("seq",), year=2024)
    as_map = {r.seq: {k: v for k, v in r.attributes.items()} for r in records.collect()}
    as_cols = {r.seq: {n: r[f"f_{n}"] for n in names if r[f"f_{n}"] is not None} for r in flat.collect()}
    assert as_map == as_cols


def test_operator_order_matters(spark):
    df = body(spark, "x")
    first = ops.apply_operators(df, [ops.add("attributes.a", "1"), ops.copy("attributes.a", "attributes.b"), ops.add("attributes.a", "2")]).first()
    assert first.attributes == {"a": "2", "b": "1"}
    second = ops.apply_operators(df, [ops.copy("attributes.a", "attributes.b"), ops.add("attributes.a", "2")]).first()
    assert second.attributes == {"a": "2"} and second._errors[0].reason == "attributes.a is missing"


def test_error_policy(spark):
    df = body(spark, "k=v", "nothing", "k=v2").withColumn("receiver", F.lit("r"))
    for policy, n in (("send", 3), ("send_quiet", 3), ("drop", 2), ("drop_quiet", 2)):
        assert ops.apply_operators(df, [ops.kv_parse(on_error=policy)]).count() == n
    kept = ops.apply_operators(df, [ops.kv_parse(on_error="drop"), ops.severity_parse("attributes.k")], keep_dropped=True)
    q = ops.parse_quality(kept).first()
    assert (q.events_in, q.events_out, q.events_dropped, q.parse_errors) == (3, 2, 1, 3)
    with pytest.raises(ValueError, match="on_error"):
        ops.apply_operators(df, [ops.kv_parse(on_error="ignore")])
    with pytest.raises(ValueError, match="unknown operator"):
        ops.apply_operators(df, [{"type": "router"}])


@pytest.mark.parametrize("text,kw,expected", [
    ("a=1 b=2", {}, {"a": "1", "b": "2"}),
    ("a=1\t\n a=3", {}, {"a": "3"}),
    ('a="x y" b=c=d', {}, {"a": "x y", "b": "c=d"}),
    ("a:1|b: 2 |", {"delimiter": ":", "pair_delimiter": "|"}, {"a": "1", "b": "2"}),
    ("a=>1, b=>2", {"delimiter": "=>", "pair_delimiter": ", "}, {"a": "1", "b": "2"}),
    ("a=1 junk b=2", {}, {}),
    ("a=1 junk b=2", {"lenient": True}, {"a": "1", "b": "2"}),
    ("a=", {}, {"a": ""}),
    ("", {}, {}),
])
def test_key_value(spark, text, kw, expected):
    row = ops.apply_operators(body(spark, text), [ops.kv_parse(**kw)]).first()
    assert row.attributes == expected
    assert (len(row._errors) == 0) == bool(expected)


@pytest.mark.parametrize("text,expected", [
    ('{"a":1,"b":"x","c":null,"d":[1,{"e":2}],"f":true}', {"a": "1", "b": "x", "c": "", "d": '[1,{"e":2}]', "f": "true"}),
    ("{}", {}), ("[1]", None), ("x", None), ("", None)])
def test_json(spark, text, expected):
    row = ops.apply_operators(body(spark, text), [ops.json_parse()]).first()
    assert row.attributes == (expected or {}) and (len(row._errors) == 1) == (expected is None)


def test_parse_targets(spark):
    df = body(spark, "7 seven")
    pattern = r"^(?P<n>\d) (?P<word>\w+)$"
    to = lambda target: ops.apply_operators(df, [ops.regex_parse(pattern, parse_to=target)]).first()
    assert to("resource").resource == {"n": "7", "word": "seven"}
    assert to("body").body == '{"n":"7","word":"seven"}'
    assert to("attributes.sub").attributes == {"sub": '{"n":"7","word":"seven"}'}
    nested = ops.apply_operators(df, [ops.regex_parse(pattern, parse_to="attributes.sub"), ops.move('attributes["sub"]', "body")]).first()
    assert nested.attributes == {} and nested.body.startswith("{")


@pytest.mark.parametrize("kind,layout,text,expected", [
    ("strptime", "%Y-%m-%dT%H:%M:%SZ", "2024-02-03T04:05:06Z", 1706933106.0),
    ("strptime", "%d/%b/%Y:%H:%M:%S %z", "03/Feb/2024:04:05:06 +0200", 1706925906.0),
    ("strptime", "%Y-%m-%d %H:%M:%S.%L", "2024-02-03 04:05:06.250", 1706933106.25),
    ("strptime", "%F %T", "2024-02-03 04:05:06", 1706933106.0),
    ("strptime", "%s", "1706933106", 1706933106.0),
    ("strptime", "at %I:%M %p on %m/%d/%y", "at 04:05 PM on 02/03/24", 1706976300.0),
    ("gotime", "2006-01-02T15:04:05Z07:00", "2024-02-03T04:05:06+01:00", 1706929506.0),
    ("gotime", "2006-01-02 15:04:05.000", "2024-02-03 04:05:06.250", 1706933106.25),
    ("gotime", "Jan _2 2006 15:04:05", "Feb 3 2024 04:05:06", 1706933106.0),
    ("epoch", "s", "1706933106", 1706933106.0),
    ("epoch", "ms", "1706933106250", 1706933106.25),
    ("epoch", "us", "1706933106250000", 1706933106.25),
    ("epoch", "ns", "1706933106250000000", 1706933106.25),
    ("epoch", "s.ms", "1706933106.250", 1706933106.25),
    ("strptime", "%Y", "never", None),
    ("epoch", "s", "never", None),
])
def test_times(spark, kind, layout, text, expected):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(text,)], "t string").select((F.unix_micros(timefmt.parse_time(F.col("t"), layout, kind)) / 1e6).alias("t"))
        assert df.first().t == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("kind,layout", [("strptime", "%Q"), ("strptime", "%A"), ("gotime", "Mon Jan 2"), ("epoch", "days"), ("other", "x")])
def test_unknown_layouts_fail_early(spark, kind, layout):
    with pytest.raises(ValueError):
        timefmt.parse_time(F.lit("x"), layout, kind)


def test_severity_names(spark):
    assert len(severity.NUMBER_NAMES) == 25 and severity.NUMBER_NAMES[0] == "UNSPECIFIED"
    assert [severity.NUMBER_NAMES[n] for n in severity.SYSLOG_NUMBERS] == ["FATAL", "ERROR3", "ERROR2", "ERROR", "WARN", "INFO2", "INFO", "DEBUG"]
    df = spark.createDataFrame([("", 17), ("custom", 17), (None, None), ("", 0)], "t string, n int").select(severity.label(F.col("t"), F.col("n")).alias("x"))
    assert [r.x for r in df.collect()] == ["ERROR", "custom", "UNSPECIFIED", "UNSPECIFIED"]


def test_syslog_edges(spark):
    sd = '<165>1 2003-10-11T22:14:15.003Z h app - ID47 [ex@1 iut="3" note="a \\"q\\" \\] \\\\"][b@2 ip="1" ip="2"] ﻿Text\nmore'
    out = normalize_syslog(body(spark, sd, "<191>1 - - - - - -", "<192>1 - - - - - - x", "plain"), "rfc5424").collect()
    a = out[0].attributes
    assert a["message"] == "Text\nmore" and a["hostname"] == "h" and "proc_id" not in a
    assert a["structured_data"] == '{"ex@1":{"iut":"3","note":"a \\"q\\" ] \\\\"},"b@2":{"ip":"2"}}'
    assert [r.envelope_matched for r in out] == [True, True, False, False]
    assert out[1].attributes == {"priority": "191", "facility": "23", "version": "1", "message": "", "content": ""}
    assert out[3].severity_text is None and out[3].body == "plain"


def test_year_from_reference(spark):
    df = body(spark, "<13>Dec 31 23:59:59 h x", "<13>Jan  1 00:00:01 h x").withColumn("at", F.lit("2025-01-01T00:00:10Z").cast("timestamp"))
    out = normalize_syslog(df, "rfc3164", reference=F.col("at"))
    assert [r.y for r in out.select(F.year("ts").alias("y")).collect()] == [2024, 2025]


def test_octet_frames(spark):
    df = spark.createDataFrame([(1, "3 abc5 12 34tail"), (2, "10 short"), (3, ""), (4, "4 éé0 2 ok"), (5, "12 a 1 b 2 c 3 ")], "id int, payload string")
    got = [(r.id, r.frame_no, r.message, r._leftover) for r in split_octet_frames(df).orderBy("id", "frame_no").collect()]
    assert got == [(1, 0, "abc", "tail"), (1, 1, "12 34", "tail"), (2, None, None, "10 short"), (3, None, None, None),
                   (4, 0, "éé", None), (4, 1, "", None), (4, 2, "ok", None), (5, 0, "a 1 b 2 c 3 ", None)]


def test_log_files(spark):
    root = shared_dir(spark)
    os.makedirs(f"{root}/a b")
    for name, text in (("a b/x.log", "one\r\ntwo\n"), ("a b/x.gz.log", "skip\n"), ("y.txt", "three\n")):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    read = lambda **kw: sorted(r.body for r in read_log_files(spark, [f"{root}/*/*.log", f"{root}/a b/x.*", f"{root}/y.txt"], [f"{root}/*/*.gz.log"], **kw).collect())
    assert read(start_at="beginning") == ["one", "three", "two"]
    assert read(start_at="end", started=datetime.now(timezone.utc) + timedelta(hours=1)) == []
    assert read(start_at="end", started=datetime.now(timezone.utc) - timedelta(hours=1)) == ["one", "three", "two"]
    with pytest.raises(ValueError):
        read(start_at="middle")


def test_stream_resumes_where_it_stopped(spark):
    root = shared_dir(spark)
    os.makedirs(f"{root}/in")

    def put(name):
        with open(f"{root}/in/{name}", "w") as f:
            f.write(name + "\n")

    def run():
        lines = read_log_files(spark, [f"{root}/in/*.log"], start_at="beginning", stream=True)
        lines.select("body").writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.body for r in spark.read.schema("body string").parquet(f"{root}/out").collect())

    put("1.log")
    assert run() == ["1.log"]
    put("2.log")
    assert run() == ["1.log", "2.log"]


@pytest.mark.parametrize("glob,path,hit", [
    ("/var/log/*.log", "file:///var/log/a.log", True), ("/var/log/*.log", "file:///var/log/x/a.log", False),
    ("/var/**/a.log", "s3://bucket/var/log/x/a.log", True), ("s3://bucket/a?.log", "s3://bucket/ab.log", True),
    ("/x/{a,b}.log", "file:/x/b.log", True), ("/x/[!a].log", "file:///x/a.log", False), ("/x/a b=1.log", "file:///x/a%20b=1.log", True)])
def test_globs(glob, path, hit):
    import re
    assert bool(re.match(glob_regex(glob), path)) is hit


def _records(spark):
    return spark.createDataFrame(
        [(1, datetime(2024, 1, 1, 0, 0, 0, 250000), "", 9, "hi", {"sourcetype": "s", "k": "v"}, {"host.name": "h"})],
        "seq bigint, ts timestamp, severity_text string, severity_number int, body string, attributes map<string,string>, resource map<string,string>")


def test_hec(spark):
    df = _records(spark)
    plain = to_hec(df).first()
    assert plain.sourcetype is None and plain.fields == {"host.name": "h", "sourcetype": "s", "k": "v"}
    assert to_hec(df, sourcetype="fixed").first().sourcetype == "fixed"
    mapped = to_hec(df, sourcetype="fixed", attr_map={"sourcetype": "sourcetype"}).first()
    assert mapped.sourcetype == "s" and "sourcetype" not in mapped.fields
    text = df.select(as_json(hec_columns(index="main")).alias("v")).first().v
    assert text == '{"time":1704067200.250000,"host":"h","event":"hi","index":"main","fields":{"host.name":"h","sourcetype":"s","k":"v"}}'
    with pytest.raises(ValueError):
        to_hec(df, attr_map={"severity": "k"})


def test_datalake_needs_a_host(spark):
    df = _records(spark)
    for settings in ({"use_hostname": False}, {"use_hostname": True, "hostname": None}):
        with pytest.raises(ValueError, match="server_host"):
            to_datalake(df, **settings)
    assert to_datalake(df, server_host="fixed", use_hostname=False).first().serverHost == "h"
    bare = df.withColumn("resource", F.lit(None).cast("map<string,string>"))
    assert to_datalake(bare, server_host="fixed", hostname="me").first().serverHost == "fixed"
    assert to_datalake(bare, hostname="me").first().serverHost == "me"


def test_debug_prints_where_records_are(spark, monkeypatch, tmp_path):
    df = spark.range(100).repartition(3).selectExpr("id", "'x' as body")

    def write(line):
        with open(tmp_path / str(os.getpid()), "a") as f:
            f.write(line + "\n")

    monkeypatch.setattr(type(df), "toLocalIterator", None)
    debug_sink(df, "normal", write)
    lines = [x for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert sorted(lines) == sorted(f"{i} | x" for i in range(100))
    assert str(os.getpid()) not in os.listdir(tmp_path)
    debug_sink(df.where("id = 7"), "detailed", lambda text: write("<" + text + ">"))
    assert "<id: 7\nbody: x\n>" in "".join(f.read_text() for f in tmp_path.iterdir())


def test_debug_and_export(spark, capsys):
    from logweave.operators.logs import export_logs
    df = _records(spark)
    debug_sink(df, "basic")
    assert "1 records" in capsys.readouterr().out
    debug_sink(df, "normal")
    debug_sink(df, "detailed")
    with pytest.raises(ValueError):
        debug_sink(df, "loud")
    path = f"{shared_dir(spark)}/export"
    export_logs(df, path)
    assert spark.read.json(path).first().body == "hi"


def test_checkpoint_folder_comes_from_the_session():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "/shared/" if key == "spark.checkpoint.dir" else default)

        class sparkContext:
            master = "yarn"

    assert shared_dir(Session).startswith("/shared/")
    Session.conf.get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
