"""Search, correlation and views over log records.

``seq`` is arrival order. The recent view is the newest records by arrival;
filters apply to that view, not before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity

# Fixed value: how many records the recent view holds.
CAPACITY = 500


def newest(df: DataFrame, n: int = CAPACITY, order: str = "seq", span: int = 4096) -> DataFrame:
    """The ``n`` rows with the highest ``order``, in any order.

    A plain top-n sends n full records from every input partition to one task.
    This first finds a lower bound: counts per ``span``-wide bucket of the order
    column (a narrow, map-side combined scan), of which the n highest are
    enough. The bound then filters the wide scan, down to Parquet statistics.
    """
    bucket = F.expr(f"`{order}` div {int(span)}")
    top = (df.filter(F.col(order).isNotNull()).groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
           .orderBy(F.desc("_b")).limit(n))
    down = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = top.withColumn("_seen", F.sum("_n").over(down))
    b = F.coalesce(F.max(F.when(F.col("_seen") >= n, F.col("_b"))), F.min("_b"))
    # Division truncates towards zero, so bucket 0 starts one span lower.
    bound = enough.agg(F.when(b > 0, b * span).otherwise((b - 1) * span).alias("bound"))
    return df.filter(F.col(order) >= bound.scalar()).orderBy(F.desc(order)).limit(n)


def recent_logs(df: DataFrame, n: int = CAPACITY) -> DataFrame:
    """The most recent ``n`` records, oldest first."""
    return newest(df, n).orderBy("seq")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("seq"))


def since_last_clear(df: DataFrame, clears: DataFrame) -> DataFrame:
    """Records that arrived after the last clear; ``clears`` has ``seq``."""
    last = clears.agg(F.max("seq").alias("seq"))
    return df.filter(F.col("seq") > F.coalesce(last.scalar(), F.lit(-(2**63))))


# --- conditions ---

#: Stands between the texts that are searched as one; it cannot be part of what is sought.
_SEP = "\x00"


def searched_text() -> Column:
    """Body, keys and values as one text, in lower case."""
    return F.lower(F.concat_ws(_SEP, "body", F.map_keys("attributes"), F.map_values("attributes"), F.map_keys("resource"), F.map_values("resource")))


def matches_text(q: str) -> Column:
    """Substring of body, attribute or resource keys or values, ignoring case."""
    q = q.lower()
    if _SEP in q:
        texts = [F.array("body"), *[f(m) for m in ("attributes", "resource") for f in (F.map_keys, F.map_values)]]
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.coalesce(F.exists(t, lambda x: F.contains(F.lower(x), F.lit(q))), F.lit(False))
        return hit
    return F.contains(searched_text(), F.lit(q))


def has_severity(s: str) -> Column:
    return F.lower("severity") == s.lower()


def has_attribute(key: str, value: str) -> Column:
    """Exact value under ``key`` in attributes or resource; a missing key reads as ''."""
    at = lambda m: F.coalesce(F.col(m)[key], F.lit("")) == value
    return at("attributes") | at("resource")


def search(df: DataFrame, q: str) -> DataFrame:
    return df.filter(matches_text(q))


def by_severity(df: DataFrame, s: str) -> DataFrame:
    return df.filter(has_severity(s))


def correlate(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(has_attribute(key, value))


def query_logs(df: DataFrame, q: str = "", severity: str = "", attr_key: str = "", attr_value: str = "",
               n: int | None = CAPACITY) -> DataFrame:
    """All filters given, over the recent view (``n=None``: over the whole table)."""
    view = df if n is None else recent_logs(df, n)
    conditions = []
    if severity:
        conditions.append(has_severity(severity))
    if attr_key:
        conditions.append(has_attribute(attr_key, attr_value))
    if q:
        conditions.append(matches_text(q))
    for condition in conditions:
        view = view.filter(condition)
    return view


# --- views ---

def severity_label(df: DataFrame) -> DataFrame:
    """Add ``severity``: the text, else the name of the number."""
    return df.withColumn("severity", severity.label(F.col("severity_text"), F.col("severity_number")))


def severity_class(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_class", severity.severity_class(F.col("severity")))


def severities(df: DataFrame) -> DataFrame:
    """Known severities, sorted."""
    return df.select("severity").filter(F.coalesce("severity", F.lit("")) != "").distinct().orderBy("severity")


def facets(df: DataFrame) -> DataFrame:
    """Every key=value of the records with the number of records that have it."""
    pairs = F.array_distinct(F.concat(
        F.coalesce(F.map_entries("attributes"), F.array()), F.coalesce(F.map_entries("resource"), F.array())))
    return df.select(F.inline(pairs)).groupBy("key", "value").agg(F.count("*").alias("records"))


def error_positions(df: DataFrame, n: int = CAPACITY) -> DataFrame:
    """Errors of the recent view by position (0 is newest) with the positions
    a jump forward and back leads to, wrapping around."""
    order = Window.orderBy(F.desc("seq"))
    shown = newest(df, n).withColumn("position", F.row_number().over(order) - 1)
    errors = shown.filter(severity.severity_class(F.col("severity")) == "error")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return errors.select(
        "seq", "position",
        F.coalesce(F.lead("position").over(order), F.first("position").over(ends)).alias("next_position"),
        F.coalesce(F.lag("position").over(order), F.last("position").over(ends)).alias("previous_position"))


def export_logs(df: DataFrame, path: str) -> None:
    """Write the records shown as JSON lines."""
    df.write.mode("errorifexists").json(path)
