"""Config documents against plain Python: leaves, redaction, graphs, and the plans behind them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import configs, topology
from logweave.plans import fleet_config
from logweave.session import shared_dir

KEYS = ["a", "b.c", "x/y", "Token", "PASSWORD", "tokens", 'q"uote', "back\\slash", "tab\tkey", "ключ", "", "[0]", "k:", "{}", '\\"', "api_key"]
VALUES = ["", "text", "${VAR}", 'say "hi"', "C:\\dir\\", "\\\\\"", "line\nbreak", "{not: [json]}", "é漢\u2028", "a:b,c", "\x01\x02", 0, -1.5, 1e30, 12345678901234567890, True, False, None, {}, []]


def some(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(VALUES)
    if kind < 0.7:
        return {k: some(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(0, 5))}
    return [some(rng, depth - 1) for _ in range(rng.randrange(0, 4))]


def leaves(value, path=(), redact=False):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            if redact and k.lower() in configs.SENSITIVE:
                yield (*path, k), configs.REDACTED, True
            else:
                yield from leaves(v, (*path, k), redact)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, (*path, f"[{i}]"), redact)
    else:
        yield path, value, isinstance(value, str)


def shown(value, is_text):
    return value if is_text else float(value) if value not in ("true", "false", "null", "{}", "[]") else value


@pytest.mark.parametrize("redact", [False, True])
def test_leaves_are_those_of_a_walk(spark, redact):
    rng = random.Random(8)
    docs = [some(rng, rng.randrange(0, 7)) for _ in range(300)] + [{"token": [[]]}, {"a": {"Secret": {"b": {}}, "c": [1]}}, [[[], {}], [{"apikey": 1}, 2]], {"token": {"token": 1}, "z": [{"password": []}, 3]}]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=rng.random() < 0.5)) for i, d in enumerate(docs)], "agent_id long, doc string")
    got = {}
    for r in configs.config_leaves(df, redact=redact).collect():
        got.setdefault(r.agent_id, []).append((tuple(r.path), shown(r.value, r.is_text), r.is_text))
    for i, d in enumerate(docs):
        want = [(p, v if t else shown(json.dumps(v), False), t) for p, v, t in leaves(d, redact=redact)]
        assert sorted(got[i], key=str) == sorted(want, key=str)


def test_long_and_wide_documents(spark):
    text = 'He said "no\\n" \\ ' * 20_000
    docs = [json.dumps({"a": text, "b": [text]}), json.dumps({"list": list(range(20_000)), "k": {f"k{i}": {"token": i} for i in range(500)}}), '{"a":' * 400 + "[7]" + "}" * 400]
    df = spark.createDataFrame(list(enumerate(docs)), "agent_id long, doc string")
    out = configs.config_leaves(df).collect()
    by = lambda i: [r for r in out if r.agent_id == i]
    assert [(r.path, r.value == text) for r in by(0)] == [(["a"], True), (["b", "[0]"], True)]
    assert {(tuple(r.path), r.value) for r in by(1)} == {(("list", f"[{i}]"), str(i)) for i in range(20_000)} | {(("k", f"k{i}", "token"), str(i)) for i in range(500)}
    assert [(len(r.path), r.path[-1], r.value) for r in by(2)] == [(401, "[0]", "7")]
    assert configs.redact(df).where("agent_id = 1 and value = '***redacted***'").count() == 500


def test_documents_beyond_the_depth_of_the_parser(spark):
    deep = lambda n: spark.createDataFrame([(1, '{"x":[' * n + '"{{[[\\\\"' + "]}" * n), (2, json.dumps(["[{" * 900, {"a": [[]] * 900}]))], "agent_id long, doc string")
    assert max(len(r.path) for r in configs.config_leaves(deep(configs.MAX_DEPTH // 2)).collect()) == configs.MAX_DEPTH
    for job in (configs.config_leaves, configs.redact, configs.config_components):
        with pytest.raises(Exception, match="nested deeper"):
            job(deep(configs.MAX_DEPTH // 2 + 1)).collect()


def test_documents_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "null"), (5, "[]")], "agent_id long, doc string")
    assert sorted((r.agent_id, r.path, r.value) for r in configs.config_leaves(df).collect()) == [(4, [], "null"), (5, [], "[]")]
    assert configs.config_leaves(df.limit(0)).count() == 0


def test_leaves_need_no_job_and_no_depth(spark):
    root = shared_dir(spark)
    spark.createDataFrame([("a", '{"x":' * 50 + "1" + "}" * 50)], "agent_id string, doc string").write.parquet(f"{root}/in")
    spark.sparkContext.setJobGroup("planning", "")
    batch = configs.config_leaves(spark.read.schema("agent_id string, doc string").parquet(f"{root}/in"))
    stream = configs.redact(spark.readStream.schema("agent_id string, doc string").parquet(f"{root}/in"))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("other", "")
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Generate variant_explode") == configs.LEVELS
    stream.writeStream.format("memory").queryName("found").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [len(r.path) for r in spark.table("found").collect()] == [50]


@pytest.mark.parametrize("name", ["edge_flow_percent", "ranked_nodes", "inbound_offsets"])
def test_a_graph_takes_one_scan_of_each_table(spark, name):
    out = getattr(fleet_config, name)(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_graph_against_plain_python(spark):
    rng = random.Random(4)
    docs, counters = [], []
    for a in range(60):
        ids = lambda kind, n: [f"{kind}/{i}" for i in range(rng.randrange(0, n))]
        receivers, exporters, names = ids("syslog", 5), ids("Hec", 3) + ids("hec", 3), ids("logs", 4)
        pick = lambda pool: [rng.choice([*pool, "ghost", 5]) for _ in range(rng.randrange(0, 5))]
        doc = {"receivers": dict.fromkeys(receivers, {}), "exporters": dict.fromkeys(exporters), "service": {"pipelines": {n: {"receivers": pick(receivers), "exporters": pick(exporters)} for n in names}}}
        docs.append((f"a{a}", json.dumps(doc)))
        own = {("receivers", i): rng.randrange(0, 4) for i in receivers if rng.random() < 0.8} | {("pipelines", i): rng.randrange(0, 9) for i in names if rng.random() < 0.8}
        counters += [(f"a{a}", s, i, "events_in", n) for (s, i), n in own.items()] + [(f"a{a}", "pipelines", "logs/0", "events_out", 99)]
        docs[-1] = (*docs[-1], doc, own)
    graphs = topology.agent_graphs(spark.createDataFrame([d[:2] for d in docs], "agent_id string, doc string"),
                                   spark.createDataFrame(counters, "agent_id string, section string, component string, field string, value bigint"))
    nodes, links = {}, {}
    for r in topology.graph_nodes(graphs).collect():
        nodes.setdefault(r.agent_id, []).append(tuple(r)[1:])
    for r in topology.graph_links(graphs).orderBy("agent_id", "link_no").collect():
        links.setdefault(r.agent_id, []).append((r["from"], r.to, r.kind, r.flow, r.percent, r.offset))
    half_up = lambda x: int(x + 0.5)
    for agent, _, doc, own in docs:
        pipes = doc["service"]["pipelines"]
        flow = lambda s, i: own.get((s, i), 0)
        total = sum(flow("receivers", i) for i in doc["receivers"])
        percent = lambda n: half_up(n * 100 / total) if total else 0
        want = []
        for type_, section, ids in (("receiver", "receivers", doc["receivers"]), ("pipeline", "pipelines", pipes), ("exporter", "exporters", doc["exporters"])):
            order = sorted(ids, key=lambda i: (-flow(section, i), i.lower(), i.swapcase()))
            want += [(i, type_, flow(section, i), percent(flow(section, i)), n + 1) for n, i in enumerate(order)]
        assert sorted(nodes.get(agent, [])) == sorted(want)
        stacked, ends = {}, []
        for p in sorted(pipes):
            for from_, to, kind, n, there in [*((i, p, "in", flow("receivers", i), i in doc["receivers"]) for i in pipes[p]["receivers"]),
                                              *((p, i, "out", flow("pipelines", p), i in doc["exporters"]) for i in pipes[p]["exporters"])]:
                if there:
                    ends.append((from_, to, kind, n, percent(n), stacked.get((kind, to), 0)))
                    stacked[kind, to] = stacked.get((kind, to), 0) + n
        assert links.get(agent, []) == ends
