"""String-map helpers. New values win over old ones; Spark's own map builders
raise on duplicate keys, so duplicates are resolved before a map is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_MAP = "map<string,string>"


def empty() -> Column:
    return F.create_map().cast(STRING_MAP)


def last_wins(keys: Column, values: Column) -> Column:
    """Map from two equally long arrays; the last value of a key is kept."""
    rkeys, rvalues = F.reverse(keys), F.reverse(values)
    distinct = F.array_distinct(keys)
    deduped = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.get(rvalues, (F.array_position(rkeys, k) - 1).cast("int"))))
    return F.when(F.size(distinct) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(deduped)


def merge(old: Column, new: Column) -> Column:
    """Union of two maps; ``new`` wins. Only maps that share a key pay for the
    per-entry filter."""
    rest = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(F.arrays_overlap(F.map_keys(old), F.map_keys(new)), F.map_concat(rest, new)).otherwise(F.map_concat(old, new))


def from_json_object(text: Column) -> Column:
    """JSON object as a string map (nested values stay JSON text, null is '').

    NULL when the text is not a JSON object.
    """
    return F.transform_values(F.from_json(text, STRING_MAP), lambda _, v: F.coalesce(v, F.lit("")))


def present(columns: dict[str, Column]) -> Column:
    """Map of the columns that are not NULL."""
    if not columns:
        return empty()
    entries = [x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
