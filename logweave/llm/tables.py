"""Tables between the steps of an operator, and class labels of linked rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session


#: Labels of which samples are taken; the driver has a count and a rate of each.
MOST_LABELS = 1000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``."""
    return session.shared_dir(spark)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends
    there, and the loss of an executor repeats no step before it."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, results: tuple[str, ...], *named: str, gone: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[..., DataFrame], list[str]]:
    """``df`` with its columns renamed c0, c1, … while an operator works, so that
    none clashes with the operator's own, whatever its case, dots or repeats.

    Also returns a function that takes a table with these columns and gives them
    their names back, followed by the columns ``results`` (a column of the caller
    that has such a name in any case is left out, and so are those in ``gone``), and
    the inner names of the columns ``named``.
    """
    taken = {r.lower() for r in (*results, *gone)}
    stay = [(f"c{i}", name) for i, name in enumerate(df.columns) if name.lower() not in taken]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(c) for c, _ in stay], *results).toDF(*[name for _, name in stay], *results)

    def inner(name: str) -> str:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name!r} among {df.columns}")
        return f"c{at[0]}"

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), back, [inner(n) for n in named]


def with_text(df: DataFrame, text: str, results: tuple[str, ...], gone: bool = False, once: bool = False) -> tuple[DataFrame, list[str], str, Callable[..., DataFrame]]:
    """For scans with Arrow: ``df`` as the columns to hand back (of ``carried``; without
    the text if it is ``gone``) and the text as a string; the names of the former, their types
    as a prefix of a schema, and the function that gives their names back. The text is the
    last column; with ``once``, if it is a string, the last of those to hand back is the
    text itself, so that it travels once."""
    inner, back, (text,) = carried(df, results, text, gone=(text,) if gone else ())
    taken = {r.lower() for r in results}
    rest = [c for c, name in zip(inner.columns, df.columns) if name.lower() not in taken and not (gone and c == text)]
    once = once and text in rest and inner.schema[text].dataType.simpleString() == "string"
    rest = sorted(rest, key=lambda c: c == text) if once else rest
    kinds = "".join(f"{c} {inner.schema[c].dataType.simpleString()}, " for c in rest)
    return inner.select(*rest, *([] if once else [F.col(text).cast("string").alias("text")])), rest, kinds, back


def digit(column: str = "doc_id") -> F.Column:
    """The remainder by 5 of the CRC-32 of an id as text; 0 marks held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


#: Bits of a bitmap for each key, and its bits at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
_PIECE = 1 << 15


def may_be_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """All ``rows`` whose ``column`` is among that of ``keys``, and few others: for before a
    join that moves wide rows. The keys' bitmap is broadcast,
    so its size has a bound; where that is reached, more rows pass."""
    bits = min(MOST_BITS, 1 << max(15, (BITS_EACH * max(keys.count(), 1) - 1).bit_length()))
    at = F.pmod(F.xxhash64(column, F.lit(17)), F.lit(bits))
    pieces = keys.select(at.alias("bit")).groupBy(F.expr(f"bit div {_PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % _PIECE).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", ((F.col("bit") % _PIECE) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bit", at).withColumn("piece", F.expr(f"bit div {_PIECE}")).join(F.broadcast(pieces), "piece")
    return found.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)


def sample_rows(rows: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """A bounded, repeatable sample: about ``per_class`` rows of each label.

    Rows are taken by a hash of their key, at a rate from an exact count per
    label, and never more than twice ``per_class`` per label in all. More than
    ``MOST_LABELS`` labels are an error: none is left out.
    """
    counts = [(r[0], r[1]) for r in rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()]
    if len(counts) > MOST_LABELS:
        raise ValueError(f"column {label!r} has more than {MOST_LABELS} labels")
    if not counts:
        return rows.limit(0)
    rate = F
    for value, n in counts:  # one flat CASE: nested ones of a thousand labels overflow the stack
        rate = rate.when(F.col(label) == F.lit(value), F.lit(per_class / n))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(draw < rate).limit(2 * per_class * len(counts))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, label), where
    label is the smallest node that can be reached. Nodes without edges have no row.

    Alternating large-star and small-star steps; each is a grouped minimum, which
    is combined before the shuffle, and a join back. The minima are stored first,
    so that both sides of the join are plain shuffles, which adaptive execution
    splits when one node has many neighbours. Every round is stored.
    """
    folder = shared_dir(edges.sparkSession)
    now = stored(_oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), folder)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), folder)
        large = stored(_oriented(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), folder)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), folder)
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(_oriented(moved.unionAll(low.select("u", F.col("m").alias("v")))), folder)
        several = now.groupBy("u").count().where("count > 1").limit(1)
        inner = now.select(F.col("v").alias("u")).join(now.select("u").distinct(), "u", "left_semi").limit(1)
        if several.unionAll(inner.withColumn("count", F.lit(0).cast("long"))).isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
