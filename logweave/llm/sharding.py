"""Shards that each hold the mixture of the sources, by proportional stratified interleaving.

The rows of a source are put in a seeded random order; the one of rank r of n is
placed at (r + offset) / n between 0 and 1, where the offset is a number of the
source's own. All rows sorted by place make one sequence in which every source
is spread evenly, and the sequence is cut into shards of equal numbers of rows.

Neither ranks nor positions come from one sort: rows are bucketed by their hash
and then by their place, counted per bucket, and numbered inside a bucket after
what the buckets before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from .tables import carried, stored

#: Rows of a bucket on average; a task sorts a few buckets.
BUCKET_ROWS = 5_000
#: A bucket of a source with more rows than this is split (rows that repeat with
#: their key fall into one bucket). There are at most rows / SPLIT_ROWS of them.
SPLIT_ROWS = 1_000_000
SEED = 11


def assign_shards(rows: DataFrame, shards: int = 40, key: str = "doc_id", source: str = "source", seed: int = SEED,
                  bucket_rows: int = BUCKET_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shards differ by one row at most, and of each source a shard holds its part,
    give or take a few rows. The order depends on key, source and seed alone; rows that
    share these are ordered by their other columns. Rows that repeat are rows of
    their own, and copies of a text need not meet in a shard. A null source is a
    source, a null key a key. With fewer rows than shards the last shards are empty;
    an empty table gives none. Columns named like the results are replaced.

    The rows are written twice on the way and shuffled twice; pass what identifies
    them and leave texts behind where those are not wanted.
    """
    inner, back, (key, source) = carried(rows, ("shard", "slot"), key, source)
    base = stored(inner.withColumns({
        "stratum": _text(source),
        "hash": F.md5(F.concat(F.lit(f"{seed}:"), _text(key))),
        "digest": F.xxhash64(*[F.col(f.name) if _hashable(f.dataType.simpleString()) else F.to_json(F.struct(f.name)) for f in inner.schema]),
        "at": F.monotonically_increasing_id(),
    }))
    total = base.count()
    buckets = max(1, -(-total // bucket_rows))
    ranked = stored(_ranked(base, buckets, split_rows, seed))

    sizes = running_total(ranked.groupBy("bucket").agg(F.count("*").alias("rows")), [], "bucket", F.col("rows"), "before", span=1024, inclusive=False)
    inside = Window.partitionBy("bucket").orderBy("place", "stratum", "hash", "digest", "at")
    placed = ranked.join(sizes, "bucket").withColumn("position", F.col("before") + F.row_number().over(inside) - 1)
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return back(placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - first))


def _ranked(base: DataFrame, buckets: int, split_rows: int, seed: int) -> DataFrame:
    """Place of each row, and the bucket of places it falls into."""
    base = base.withColumn("part", F.expr(f"(cast(conv(substr(hash, 1, 8), 16, 10) as long) * {buckets}) div {1 << 32}"))
    full = base.groupBy("stratum", "part").agg(F.count("*").alias("held")).where(F.col("held") > split_rows)
    pieces = F.expr(f"held div {split_rows} + 1")
    base = base.join(F.broadcast(full), ["stratum", "part"], "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("digest", "at"), pieces), F.lit(0).cast("long")))

    cell = ["stratum", "part", "piece"]
    whole = Window.partitionBy("stratum")
    sizes = base.groupBy(*cell).agg(F.count("*").alias("rows"))
    sizes = sizes.select(
        *cell, F.sum("rows").over(whole).alias("of"),
        (F.sum("rows").over(whole.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "digest", "at")) - 1
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:source:"), "stratum")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    place = ((rank + offset) / F.col("of"))
    return base.join(sizes, cell).withColumn("place", place).withColumn(
        "bucket", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1))).drop("part", "piece", "held", "of", "before")


def write_shards(assigned: DataFrame, folder: str, file_rows: int = 1_000_000) -> None:
    """Write assigned rows as Parquet, a folder ``shard=n`` each. A shard's slots are
    dealt over tasks in stretches of ``file_rows``, and lie in order within a file."""
    dealt = assigned.repartition("shard", F.expr(f"slot div {file_rows}")).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(folder)


def _text(column: str) -> Column:
    """A column as text; null differs from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _hashable(kind: str) -> bool:
    return not any(word in kind for word in ("map<", "variant"))
