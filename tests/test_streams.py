"""Tables that streams keep: few folders, replays, silent agents, scrapes that never end."""

import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.session import shared_dir
from logweave.sources.files import read_log_files
from logweave.streaming import fleet as live
from logweave.streaming.delivery import quality_counts, quality_stream
from logweave.streaming.runs import Runs, added_up, combined_at, newest_by, runs_before

MESSAGE = """agent_id string, seq long, ts timestamp, description struct<hostname:string,service_version:string,local_ui_addr:string>, health struct<healthy:boolean,last_error:string>,
    snapshot_json string, started_at string, effective_config string, config_status struct<status:string,error:string>, package_status struct<status:string,error:string>,
    config_push struct<content:string>, package_push struct<name:string,version:string,hash:string>, deleted boolean"""


def folders(path):
    return sorted(d[len(path) + 1:] for d, _, _ in os.walk(path) if "/run=" in d and "/bucket=" not in d)


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.startswith("part-"))


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_all_batches_once(fan):
    live_runs = set()
    for n in range(300):
        for run, parts in combined_at(n, fan):
            assert set(parts) <= live_runs
            live_runs = (live_runs - set(parts)) | {run}
        covered = [b for level, i in runs_before(n, fan) for b in range(i * fan**level, (i + 1) * fan**level)]
        assert covered == list(range(n)) and set(runs_before(n, fan)) == live_runs
        live_runs.add((0, n))


def test_counts_lie_in_few_folders_and_replays_count_once(spark):
    root = shared_dir(spark)
    runs = Runs(root, spark.createDataFrame([], "k string, n long").schema, added_up(["k"], ["n"]), fan=2)
    assert runs.newest(spark).count() == 0
    for n in range(20):
        for attempt in range(3 if n in (4, 7, 8, 16) else 1):  # replays, also where runs are combined; attempts that failed had other rows
            runs.begin(spark, n)
            rows = [("a", 1), (None, 2)] + [("wrong", 1)] * (attempt == 0 and n in (4, 7, 8, 16))
            runs.write(spark.createDataFrame(rows, "k string, n long"), n)
        assert sorted(runs.newest(spark).collect(), key=str) == [("a", n + 1), (None, 2 * n + 2)]
        # One run a level, the parts of the last combination and the batch itself.
        assert len(folders(root)) <= 2 * (n + 2).bit_length() + 2


def test_state_is_written_for_the_agents_of_a_batch_alone(spark):
    written = {}
    for silent in (50, 5000):
        root = shared_dir(spark)
        runs = Runs(root, spark.createDataFrame([], "agent_id string, batch long, gone boolean, text string").schema, newest_by("agent_id", "batch", "gone"), "agent_id", buckets=16)
        make = lambda ids, n, gone=False: spark.createDataFrame([(f"agent-{i}", n, gone, f"text of {i} after {n}" * 20) for i in ids], runs.schema)
        runs.begin(spark, 0)
        runs.write(make(range(silent), 0), 0)
        sizes = []
        for n in range(1, 6):
            runs.begin(spark, n)
            runs.write(make([1, 2], n), n)
            sizes.append(size(runs.folder((0, n))))
            assert len(os.listdir(runs.folder((0, n)))) <= 2 + 2  # buckets of two agents, success mark and its checksum
        written[silent] = max(sizes)
        runs.write(make([3], 5, True), 5)  # batch 5 again: agent 3 is deleted, 1 and 2 are not in it
        got = {r.agent_id: r.batch for r in runs.newest(spark).collect()}
        assert got == {f"agent-{i}": 4 if i in (1, 2) else 0 for i in range(silent) if i != 3}
        own = runs.before(spark, 5, [r[0] for r in make([1], 0).select(runs.bucket()).collect()]).select("agent_id").distinct()
        assert 0 < own.count() < silent / 4
    assert written[5000] == written[50]


def messages(rng, n, agents, seq):
    rows = []
    for i in range(n):
        kind = rng.choice(["hello", "health", "start", "config", "push", "status", "package", "installed", "delete"] if rng.random() < 0.9 else ["hello"])
        agent, at = f"a{rng.randrange(agents)}", seq + i
        row = {"agent_id": agent, "seq": at}
        if kind == "hello":
            row["description"] = (f"host-{at}", "1", "u")
        elif kind == "health":
            row["health"] = (rng.random() < 0.5, f"e{at}")
        elif kind == "start":
            row["started_at"] = f"2024-01-01T00:00:{at % 60:02d}Z"
        elif kind == "config":
            row["effective_config"] = f"config {at % 5}"
        elif kind == "push":
            row["config_push"] = (f"config {at % 5}",)
        elif kind == "status":
            row["config_status"] = (rng.choice(["APPLIED", "FAILED"]), f"c{at}")
        elif kind == "package":
            row["package_push"] = ("p", str(at), f"h{at}")
        elif kind == "installed":
            row["package_status"] = (rng.choice(["Installed", "InstallFailed"]), f"p{at}")
        else:
            row["deleted"] = True
        rows.append(row)
    return rows


def test_state_over_many_batches_is_that_of_one(spark):
    rng = random.Random(3)
    shape = spark.createDataFrame([], MESSAGE).schema
    # Some messages have no time.
    rows = [[r.get(c) if c != "ts" else datetime(2024, 1, 1, i // 60, i % 60) if i % 3 else None for c in shape.names] for i, r in enumerate(messages(rng, 160, 6, 0))]
    ends = []
    for parts, fan in ((1, 8), (6, 2)):
        root = shared_dir(spark)
        for p in range(parts):
            spark.createDataFrame(rows[160 * p // parts:160 * (p + 1) // parts], shape).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(shape).parquet(f"{root}/in")
            live.fleet_state_stream(stream, f"{root}/out", f"{root}/cp", fan=fan, buckets=4).awaitTermination()
        ends.append(sorted(map(str, live.current_state(spark, f"{root}/out", fan=fan, buckets=4).collect())))
    assert ends[0] == ends[1] and len(ends[0]) > 3
    assert len(folders(f"{root}/out")) < 10


LINE = "agent_id string, scrape_id long, lines long, line_no long, text string, error string, started_at string, scraped_at timestamp"


def test_messages_of_a_batch_meet_the_deletes_once(spark, monkeypatch):
    root, kept, summarise = shared_dir(spark), [], live.summarise
    before = spark.sparkContext._jsc.getPersistentRDDs().size()

    def watched(rows, alive):
        kept.append((alive.storageLevel.useMemory, sorted((r.agent_id, r.seq) for r in alive.collect())))
        return summarise(rows, alive)

    monkeypatch.setattr(live, "summarise", watched)
    row = lambda agent, seq, **more: {"agent_id": agent, "seq": seq, "ts": datetime(2024, 1, 1, 0, seq), **more}
    rows = [row("a", 1, started_at="x"), row("a", 2, deleted=True), row("a", 3, started_at="y"), row("a", 4, started_at="z"), row("b", 5, deleted=True), row("c", 6, config_push={"content": "k"})]
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"{root}/in")
    live.fleet_state_stream(spark.readStream.schema(MESSAGE).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp").awaitTermination()
    assert kept == [(True, [("a", 3), ("a", 4), ("c", 6)])]
    got = live.current_state(spark, f"{root}/out").select("agent_id", "last_started_at", F.array_join("restart_history", ","), "pending_config")
    assert sorted(map(tuple, got.collect())) == [("a", "z", "z", ""), ("c", "", "", "k")]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_scrape_that_never_ends_fails(spark):
    root = shared_dir(spark)
    sample = 'otelcol_receiver_accepted_log_records{receiver="r"} %d'
    line = lambda agent, scrape, of, no, n: (agent, scrape, of, no, sample % n, None, "2024-01-01T00:00:00Z", None)
    routes = spark.createDataFrame([(a, "p", ["r"], ["x"]) for a in "abc"], "agent_id string, pipeline string, receivers array<string>, exporters array<string>")
    ids = lambda i: spark.createDataFrame([(a, i) for a in "abc"], "agent_id string, id string")

    def feed(rows, timeout):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(LINE).parquet(f"{root}/in")
        live.report_stream(stream, routes, ids("r"), ids("x"), f"{root}/out", f"{root}/cp", every=None, timeout=timeout).awaitTermination()
        got = live.current_reports(spark, f"{root}/out").select("agent_id", "healthy", "last_error", F.get_json_object("snapshot_json", "$.receivers.r.events_in").alias("n"))
        return sorted(tuple(r) for r in got.collect())

    waiting = lambda n: spark.read.parquet(f"{root}/out/open/version={n}").count()
    assert feed([line("a", 1, 1, 1, 4), line("b", 1, 3, 1, 5), line("b", 1, 3, 2, 5)], 1000) == [("a", True, "", "4")]
    assert feed([line("a", 2, 2, 1, 9)], 1000) == [("a", True, "", "4")] and waiting(1) == 3
    time.sleep(0.1)
    # Both have waited; what comes in time is not cut. Agent a keeps its counters, b never had any.
    assert feed([line("c", 1, 2, 1, 1)], 0.05) == [("a", False, "scrape incomplete: 1 of 2 lines", "4"), ("b", False, "scrape incomplete: 2 of 3 lines", None)]
    assert waiting(2) == 1
    assert feed([line("a", 3, 1, 1, 6), line("c", 1, 2, 2, 1)], 1000)[::2] == [("a", True, "", "6"), ("c", True, "", "2")]
    assert waiting(3) == 0 and not os.path.exists(f"{root}/out/open/version=1")


def test_a_batch_makes_one_document_for_an_agent(spark, monkeypatch):
    root = shared_dir(spark)
    sample = 'otelcol_receiver_accepted_log_records{receiver="r"} %d'
    routes = spark.createDataFrame([(a, "p", ["r"], ["x"]) for a in "ab"], "agent_id string, pipeline string, receivers array<string>, exporters array<string>")
    ids = lambda i: spark.createDataFrame([(a, i) for a in "ab"], "agent_id string, id string")
    made, documents = [], live.m.status_documents

    def counted(agents, samples, *rest):
        made.append((sorted(r.scrape_id for r in agents.collect()), samples.count()))
        return documents(agents, samples, *rest)

    monkeypatch.setattr(live.m, "status_documents", counted)
    rows = [("a", scrape, 1, 1, sample % (10 * scrape), None, "2024-01-01T00:00:00Z", None) for scrape in (3, 1, 5, 2, 4)]
    rows += [("a", 6, 1, 1, None, "refused", None, None), ("b", 7, 1, 1, None, "refused", None, None), ("b", 2, 2, 1, sample % 1, None, None, None)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{root}/in")
    live.report_stream(spark.readStream.schema(LINE).parquet(f"{root}/in"), routes, ids("r"), ids("x"), f"{root}/out", f"{root}/cp", every=None).awaitTermination()
    got = live.current_reports(spark, f"{root}/out").select("agent_id", "healthy", "last_error", F.get_json_object("snapshot_json", "$.receivers.r.events_in").alias("n"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", False, "refused", "50"), ("b", False, "refused", None)]
    assert made == [([5], 1)] and spark.read.parquet(f"{root}/out/open/version=0").count() == 1


def test_a_batch_keeps_its_arrival(spark):
    folder = shared_dir(spark)
    seen = [spark.range(1).select(F.unix_micros(live._arrival(spark, folder, n))).first()[0] for n in (0, 0, 1, 1)]
    assert seen[0] == seen[1] < seen[2] == seen[3]


def test_quality_over_many_batches(spark):
    root = shared_dir(spark)
    shape = "ts timestamp, receiver string, _dropped boolean, _errors array<string>"
    for i in range(9):
        spark.createDataFrame([(None, "r", i % 3 == 0, ["e"] if i % 2 else [])], shape).write.mode("append").parquet(f"{root}/in")
        quality_stream(spark.readStream.schema(shape).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp").awaitTermination()
    assert [tuple(r) for r in quality_counts(spark, f"{root}/out").collect()] == [(None, "r", 9, 6, 3, 4)]


@pytest.mark.parametrize("pattern", ["late/*.log", "late/app.log", "late", "late/*/app.lo?", "la{te,ter}/app.log"])
def test_a_stream_waits_for_its_first_file(spark, pattern):
    root = shared_dir(spark)
    lines = read_log_files(spark, [f"{root}/{pattern}"], start_at="beginning", stream=True)
    query = lines.writeStream.format("memory").queryName("late").option("checkpointLocation", f"{root}/cp").start()
    try:
        query.processAllAvailable()
        assert spark.table("late").count() == 0
        folder = f"{root}/late/one" if pattern == "late/*/app.lo?" else f"{root}/late"
        os.makedirs(folder)
        with open(f"{folder}/app.log", "w") as f:
            f.write("first\nsecond\n")
        query.processAllAvailable()
        assert sorted(r.body for r in spark.table("late").collect()) == ["first", "second"]
    finally:
        query.stop()


def test_delivered_text_is_packed_and_totals_go_part_by_part(spark, monkeypatch):
    from logweave.plans import delivery as plans
    sf = "/root/testdata/sf0.001"
    roots, parts = [], []
    feed, delivered = plans._feed, plans._delivered
    monkeypatch.setattr(plans, "_feed", lambda *a, **b: roots.append(feed(*a, **b)) or roots[-1])
    monkeypatch.setattr(plans, "_delivered", lambda sent: parts.append(1) or delivered(sent))
    whole = sorted(map(str, plans.live_delivery(spark, sf).collect()))
    out = roots[0]
    files = [f"{d}/{f}" for d, _, names in os.walk(out.removeprefix("file://")) for f in names if f.startswith("part-")]
    raw = spark.read.option("recursiveFileLookup", "true").text(out).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert files and all(f.endswith(".gz") for f in files) and 2 * sum(map(os.path.getsize, files)) < raw
    monkeypatch.setattr(plans, "PART_BYTES", sum(map(os.path.getsize, files)) // 4)
    key, parts[:] = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    assert sorted(map(str, plans.live_delivery(spark, sf).collect())) == whole
    assert len(parts) > 3 and spark.conf.get(key) == before
