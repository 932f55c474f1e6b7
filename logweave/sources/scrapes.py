"""Metric scrapes in the text exposition format -> samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from ..operators.chain import computed_once

# The sample line and label grammars.
_LINE = r"(?d)^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?[\t\n\f\r ]+([^\t\n\f\r ]+)\z"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="([^"\\]*(?:\\.[^"\\]*)*)"'


def read_metric_scrapes(lines: DataFrame) -> DataFrame:
    """Samples ``(scrape_id, line_no, family, labels, value)`` from text lines.

    ``lines`` has ``scrape_id, line_no, text``; other columns are kept. Blank
    lines, comments, malformed lines and bad numbers give no row.
    """
    kept = [c for c in lines.columns if c not in ("line_no", "text")]
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    df = computed_once(lines.withColumn("text", text), "_hit", F.when(
        F.col("text").rlike(_LINE), F.struct(*[F.regexp_extract("text", _LINE, i).alias(n) for i, n in ((1, "family"), (2, "labels"), (3, "number"))])))
    number, labels = F.col("_hit.number"), F.col("_hit.labels")
    value = number.try_cast("double")
    # Java reads '1d' and overflows '1e999' quietly; neither is a sample.
    good = ~number.rlike(r"[0-9.][dDfF]$") & (~F.abs(value).isin(float("inf")) | F.lower(number).contains("inf"))
    keys = F.regexp_extract_all(labels, F.lit(_LABEL), F.lit(1))
    values = F.regexp_extract_all(labels, F.lit(_LABEL), F.lit(2))
    return df.filter(F.col("_hit").isNotNull() & value.isNotNull() & good).select(
        *kept, "line_no", F.col("_hit.family").alias("family"), maps.last_wins(keys, values).alias("labels"), value.alias("value"))
