"""Steps that split hot keys give the same rows as the plain way."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators import fleet, joins, metrics
from logweave.operators.joins import is_small, join_dimension, look_up
from logweave.operators.ordered import count_within, running_total, with_previous
from logweave.operators.routing import route_in, route_out
from logweave.session import shared_dir


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows under one key."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        F.col("id").alias("seq"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("v"))


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("span", [7, 100, 1_000_000])
@pytest.mark.parametrize("following", [False, True])
def test_previous_row(hot, span, following):
    w = Window.partitionBy("k").orderBy("seq")
    plain = hot.withColumn("p", (F.lead if following else F.lag)("v").over(w))
    same(with_previous(hot, ["k"], "seq", ["v"], span, following=following).select("k", "seq", "v", F.col("_prev.v").alias("p")), plain)


@pytest.mark.parametrize("span", [7, 1_000_000])
def test_change_points(hot, span):
    w = Window.partitionBy("k").orderBy("seq")
    plain = hot.withColumn("p", F.lag("v").over(w)).filter("p is null or p <> v").drop("p")
    same(with_previous(hot, ["k"], "seq", ["v"], span, keep=lambda p: p.isNull() | (p["v"] != F.col("v"))).drop("_prev"), plain)


@pytest.mark.parametrize("span", [7, 1_000_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_total(hot, span, inclusive):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = hot.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    same(running_total(hot, ["k"], "seq", F.col("v"), "t", span, inclusive), plain)


@pytest.mark.parametrize("span", [60, 61, 5000, None])
def test_count_within(hot, span):
    w = Window.partitionBy("k").orderBy("seq").rangeBetween(-59, 0)
    same(count_within(hot, ["k"], "seq", 60, "n", span), hot.withColumn("n", F.count("*").over(w)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(hot, how):
    dim = hot.sparkSession.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("nobody", 4)], "k string, d int")
    plain = hot.join(dim, "k", how)
    same(join_dimension(hot, dim, ["k"], how), plain)
    salted = join_dimension(hot, dim, ["k"], how, size=2)
    assert "Generate explode" in salted._jdf.queryExecution().executedPlan().toString()
    same(salted, plain)


def test_salted_join_with_maps(hot):
    df = hot.withColumn("m", F.create_map("k", "k"))
    dim = hot.select("k").distinct()
    assert join_dimension(df, dim, ["k"], size=1).count() == hot.count()


def test_size_check(spark):
    """Sizes come from statistics: nothing is run."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizes", "")
    assert is_small(spark.range(10)) and not is_small(spark.range(11), size=80)
    join_dimension(spark.range(100).withColumnRenamed("id", "k"), spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("x")), ["k"])
    assert not tracker.getJobIdsForGroup("sizes")
    spark.sparkContext.setJobGroup("other", "")


def test_look_up(hot):
    dim = hot.groupBy("k").agg(F.sum("v").alias("s")).where("k <> 'k5'")
    for size in (None, 0):
        same(look_up(hot, dim, ["k"], size=size), hot.join(dim, "k", "left"))


def test_a_hot_receiver_spreads_in_a_stream(spark):
    """Nine records in ten are of one receiver, and the routes are too many to broadcast."""
    root = shared_dir(spark)
    spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("receiver"), F.col("id").alias("seq")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("receiver string, seq long").parquet(f"{root}/in")
    members = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "a")], "receiver string, pipeline string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        routed = join_dimension(stream, members, ["receiver"], size=1).withColumn("task", F.spark_partition_id())
        routed.writeStream.format("memory").queryName("routed").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
        seen = spark.table("routed").groupBy("task").count().collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(r["count"] for r in seen) == 2 * 18_000 + 2_000
    assert max(r["count"] for r in seen) < 12_000 and len(seen) == 8


def test_a_shared_exporter_is_split_without_adaptive_joins(spark, monkeypatch):
    """One exporter in all pipelines, adaptive execution off."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    n = 4000
    pipelines = spark.range(n).select(F.lit("f").alias("agent_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("pipeline"))
    receivers = pipelines.withColumn("id", F.col("pipeline"))
    exporters = pipelines.withColumn("id", F.lit("x"))
    one = lambda id_, k: spark.createDataFrame([("f", id_, k)], "agent_id string, id string, n long")
    accepted = receivers.select("agent_id", "id", F.lit(2).cast("long").alias("n"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = metrics.attribute_members(receivers, exporters, accepted, one("x", n * 3), one("x", n))
        assert [tuple(r) for r in out.groupBy("events_in", "events_out", "events_dropped").count().collect()] == [(2, 3, 1, n)]
        uses = look_up(exporters, one("x", 1), ["agent_id", "id"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in uses) < n / 2
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_no_record_is_lost_and_fan_out_adds_up(hot):
    spark = hot.sparkSession
    records = hot.withColumnRenamed("k", "receiver")
    routes = spark.createDataFrame([("logs/a", ["hot", "k1"], ["x", "y"]), ("logs/b", ["hot", "hot"], ["x"]), ("logs/c", [], ["z"])],
                                   "pipeline string, receivers array<string>, exporters array<string>")
    n = {r.receiver: r["count"] for r in records.groupBy("receiver").count().collect()}
    routed = route_in(records, routes)
    assert routed.count() == 3 * n["hot"] + n["k1"]
    assert route_out(routed, routes).count() == 2 * (n["hot"] + n["k1"]) + 2 * n["hot"]


def fold(events):
    """The rollout machine, one event after the other."""
    pending = good = error = ""
    for kind, payload in events:
        if kind == "push":
            pending = payload
        elif kind == "applied" and pending:
            good, pending, error = pending, "", ""
        elif kind == "failed":
            pending, error = "", payload
    return pending, good, error


@pytest.mark.parametrize("span", [3, 1000])
def test_rollout_equals_sequential_fold(spark, span):
    rnd = random.Random(5)
    pushes, outcomes, expected = [], [], {}
    for a in range(120):
        events = []
        for seq in range(rnd.randint(1, 14)):
            kind = rnd.choice(["push", "push", "applied", "failed"])
            events.append((kind, f"{a}-{seq}"))
            if kind == "push":
                pushes.append((str(a), seq, f"{a}-{seq}"))
            else:
                outcomes.append((str(a), seq, (kind.upper(), f"{a}-{seq}")))
        expected[str(a)] = fold(events)
    p = spark.createDataFrame(pushes, "agent_id string, seq bigint, content string")
    m = spark.createDataFrame(outcomes, "agent_id string, seq bigint, config_status struct<status:string,error:string>")
    got = {r.agent_id: (r.pending_config, r.last_known_good_config, r.last_config_error) for r in fleet.config_rollout(m, p, span).collect()}
    assert got == expected


def test_exploded_rows_are_more_than_statistics_say(spark, tmp_path):
    spark.range(100_000).select(F.concat(F.lit("agent-"), "id").alias("k")).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    made = keys.select("k", F.explode(F.array(*[F.concat("k", F.lit(f"/{i}")) for i in range(50)])).alias("member"))
    assert is_small(keys) and not is_small(made) and not is_small(made.select(F.lit(1).alias("one")))


def test_a_key_is_copied_only_to_its_salts(spark):
    """Of a thousand keys with one row each, not 32 copies of a dimension's rows."""
    fact = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    dim = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("d"))
    joined = join_dimension(fact, dim, ["k"], size=1)
    same(joined, fact.join(dim, "k"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "Generate explode" in plan
