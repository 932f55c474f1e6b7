"""Search over stored records with and without the index."""

import os
import random

from pyspark.sql import functions as F

from logweave.operators import log_index, logs
from logweave.session import shared_dir

SHAPE = "seq long, body string, attributes map<string,string>, resource map<string,string>"


def write(spark, root, n, seed, first=0):
    """A file of records each; words of a file are its own, but for a few."""
    rng = random.Random(seed)
    for i in range(first, first + n):
        rows = [(i * 100 + j, rng.choice([None, "", f"Disk{i} failed on ÄRGER {rng.randrange(9)}", "common text"]), {f"key{i}": rng.choice(["v", f"Value-{i}-{j}", None])}, None if j % 2 else {"host.name": f"h{j}"}) for j in range(20)]
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{root}/records")


def test_answers_are_those_of_the_plain_search(spark):
    root = shared_dir(spark)
    write(spark, root, 6, 1)
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    write(spark, root, 2, 2, first=6)  # files without an entry
    whole = spark.read.parquet(f"{root}/records")
    for q in ("disk3", "DISK7 FAILED", "ärger 4", "value-5-1", "common", "key2", "host.name", "h1", "", "nowhere", "x\x00y", "isk", "e", "3 fail", "failed on ärger", "a" * 500):
        found = log_index.search_stored(spark, f"{root}/records", f"{root}/index", q)
        assert sorted(r.seq for r in found.collect()) == sorted(r.seq for r in logs.search(whole, q).collect()), q


def test_only_files_that_may_match_are_read(spark):
    root = shared_dir(spark)
    write(spark, root, 8, 3)
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    read = lambda q: len(log_index.search_stored(spark, f"{root}/records", f"{root}/index", q).inputFiles())
    assert read("Disk5 failed") == 1 and read("value-2-") == 1 and read("common text") == 8
    assert log_index.search_stored(spark, f"{root}/records", f"{root}/index", "nowhere at all").count() == 0
    # A second call adds only what is new.
    before = spark.read.parquet(f"{root}/index").count()
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    assert spark.read.parquet(f"{root}/index").count() == before
    write(spark, root, 1, 4, first=8)
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    assert spark.read.parquet(f"{root}/index").select("file").distinct().count() == 9 and read("Disk8 failed") == 1


def test_tables_in_folders_and_odd_names(spark):
    root = shared_dir(spark)
    rows = [(i, f"word{i} here", {"a": "b"}, {}) for i in range(4)]
    spark.createDataFrame(rows, SHAPE).withColumn("Day of", F.concat(F.lit("2024/"), F.col("seq"))).write.partitionBy("Day of").parquet(f"{root}/records")
    log_index.build_index(spark, f"{root}/records", f"{root}/index")
    out = log_index.search_stored(spark, f"{root}/records", f"{root}/index", "word2")
    assert [tuple(r) for r in out.select("seq", "Day of").collect()] == [(2, "2024/2")] and len(out.inputFiles()) == 1
    assert os.path.isdir(f"{root}/index")


def test_each_bit_of_a_file_is_sorted_once(spark):
    alphabet = "aäb é\n\U0001f600c"
    rows = [(f"file:/f{i % 3}", "".join(random.Random(i).choice(alphabet) for _ in range(i))) for i in [*range(200), 5000]] + [("file:/f3", None), ("file:/f3", "ab")]
    found = log_index._bitmaps(spark.createDataFrame(rows, "file_path string, text string"))
    want = {(f, t[i:i + 3]) for f, t in rows for i in range(len(t or "") - 2)}
    places = spark.createDataFrame(sorted(want), "file string, gram string").select("file", log_index._place(F.col("gram")).alias("at")).distinct()
    assert sum(bin(int.from_bytes(r.bits)).count("1") for r in found.collect()) == places.count()
    whole = places.groupBy("file", F.expr(f"cast(at div {log_index._PIECE} as int)").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % log_index._PIECE).alias("bits"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    # The exploded trigrams are combined by hashing; only what is left meets the sort of the bitmaps.
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" in plan[plan.rindex("SortAggregate"):plan.index("Generate")]
