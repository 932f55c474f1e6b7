"""Order-dependent steps that never gather one key into one task.

A window partitioned by agent puts all rows of a chatty agent into one task.
Here rows are split into chunks of the order column as well: a window inside
each chunk does the work, and only one row per chunk crosses chunk borders.
Results are exact whatever the chunk width; it only bounds the group size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key per chunk are at most this many when the order column is a
# sequence number.
CHUNK_ROWS = 1_000_000


def _chunk(order: str, span: int) -> Column:
    return F.expr(f"`{order}` div {int(span)}")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], span: int = CHUNK_ROWS,
                  keep: Callable[[Column], Column] | None = None, following: bool = False) -> DataFrame:
    """Add ``_prev``: the values of the row before, within ``keys``, by ``order``.

    ``order`` is a number unique within ``keys``; ``_prev`` is NULL on the first
    row. ``keep`` (a condition on ``_prev``) drops rows before they cross chunk
    borders; it is applied to every row exactly once. ``following`` looks at
    the row after instead.
    """
    value = F.struct(*values)
    by = F.col(order).desc() if following else F.col(order).asc()
    chunk_by = F.col("_chunk").desc() if following else F.col("_chunk").asc()
    inside = Window.partitionBy(*keys, "_chunk").orderBy(by)
    whole = Window.partitionBy(*keys, "_chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The struct itself is never NULL, so NULL means first row of the chunk.
    base = df.withColumn("_chunk", _chunk(order, span)).withColumns({
        "_prev": F.lag(value).over(inside),
        "_tail": F.last(value).over(whole),
    })
    head = F.col("_prev").isNull()
    if keep is None:
        # Both branches read one shuffle; only first rows are shuffled again.
        across = Window.partitionBy(*keys).orderBy(chunk_by)
        heads = base.filter(head).withColumn("_prev", F.lag("_tail").over(across))
        rows = base.filter(~head).unionByName(heads)
    else:
        # Few rows are kept: one pass over all, then another shuffle of those.
        # First rows meet under the key, the others stay with their chunk.
        kept = base.filter(head | keep(F.col("_prev"))).withColumn("_at", F.when(~head, F.col("_chunk")))
        across = Window.partitionBy(*keys, "_at").orderBy(chunk_by)
        rows = kept.withColumn("_prev", F.when(head, F.lag("_tail").over(across)).otherwise(F.col("_prev")))
        rows = rows.filter(keep(F.col("_prev"))).drop("_at")
    return rows.drop("_chunk", "_tail")


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                  span: int = CHUNK_ROWS, inclusive: bool = True) -> DataFrame:
    """Add the running sum of ``value`` within ``keys`` by ``order``.

    Chunk sums are combined map-side; their prefix sums join back on the chunk,
    which is also the partitioning of the window that follows.
    """
    base = df.withColumn("_chunk", _chunk(order, span)).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum")).select(
        *keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return base.join(carry, [*keys, "_chunk"]).withColumn(
        name, F.col("_carry") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    ).drop("_chunk", "_value", "_carry")


def count_within(df: DataFrame, keys: Sequence[str], at: str, width: int, name: str, span: int | None = None) -> DataFrame:
    """Add the number of rows of the same key with ``at`` in ``(at - width, at]``.

    ``at`` is a number (microseconds, say). Each chunk of the axis also gets
    the rows that lie within ``width`` before it, so a chunk can be counted on
    its own; ``span`` is at least ``width``.
    """
    span = max(span or width * 144, width)
    base = df.withColumn("_chunk", _chunk(at, span)).withColumn("_own", F.lit(True))
    late = (F.col(at) + width - 1 >= (F.col("_chunk") + 1) * span)
    copies = base.filter(late).withColumns({"_chunk": F.col("_chunk") + 1, "_own": F.lit(False)})
    near = Window.partitionBy(*keys, "_chunk").orderBy(at).rangeBetween(-(width - 1), Window.currentRow)
    return base.unionByName(copies).withColumn(name, F.count("*").over(near)).filter("_own").drop("_chunk", "_own")


def latest(df: DataFrame, keys: Sequence[str], order: str, fields: dict[str, tuple[Column, Column]],
           extra: Sequence[Column] = ()) -> DataFrame:
    """Per key, for each ``{name: (value, condition)}`` the value of the last
    row by ``order`` that meets the condition, plus ``extra`` aggregates.

    One pass; every task sends one row per key it saw.
    """
    return df.groupBy(*keys).agg(*[
        F.max_by(F.when(cond, value), F.when(cond, F.col(order))).alias(name)
        for name, (value, cond) in fields.items()
    ], *extra)
