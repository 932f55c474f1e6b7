"""Joining large tables to dimension tables when a few keys hold most rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dimension that Spark's statistics take to be larger is not broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: What a table with exploded rows may hold for each byte that statistics give it: they
#: know the packed files and take every row to give one.
MADE = 100
_UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}


def estimated_bytes(df: DataFrame) -> float:
    """The size of a table by the optimizer's statistics: of its files, or of the
    plan above them. Nothing is run."""
    text = df.sparkSession.sql("explain cost select * from {df}", df=df).first()[0]
    plan = text.split("== Physical Plan ==")[0]
    sizes = [float(n) * _UNITS.get(unit, float("inf")) for n, unit in re.findall(r"sizeInBytes=([0-9.E+]+) (\w+)", plan)]
    # Steps that narrow rows make the estimate smaller, those that explode them don't make it larger.
    return MADE * max(sizes) if re.search(r"(?m)^[ :+-]*Generate ", plan) else sizes[0]


def is_small(dim: DataFrame, size: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(dim) <= size


def join_dimension(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", size: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Inner or left join of a large, possibly skewed table or stream to a dimension.

    A dimension that is small by its statistics is broadcast. Of a larger one, a key has a
    copy for each salt that it has in ``fact``, so that the rows of a hot key spread over
    ``salts`` tasks, without help from adaptive execution, which streams do not have. In
    a stream, and where salts hang on fractions, which sums may give otherwise when they are
    read again, there is a copy for every salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if is_small(dim, size):
        return _to_all(fact, dim, on, how)
    salted, every = fact.withColumn("_salt", _salt(fact, salts)), F.array(*[F.lit(i) for i in range(salts)])
    if fact.isStreaming or salts > 63 or any(re.search("float|double", t) for _, t in fact.dtypes):
        copies = dim.withColumn("_salt", F.explode(every))
    else:
        # A bit for each salt of a key, combined before the shuffle.
        bits = salted.groupBy(*on).agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_bits"))
        copies = dim.join(bits.hint("merge"), list(on)).withColumn("_salt", F.explode(F.filter(every, lambda i: F.getbit("_bits", i) == 1))).drop("_bits")
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def look_up(fact: DataFrame, dim: DataFrame, on: Sequence[str], salts: int = SALTS, size: int | None = None) -> DataFrame:
    """Left join of a table to another one that may be as large, but has one row per key.

    One that is small by its statistics is broadcast. Else, which salts a key has in ``fact`` is found out first (combined before the
    shuffle); only these get a copy of the key's row. A hot key has ``salts`` tasks, a
    rare one no more rows than before.
    """
    if is_small(dim, BROADCAST_BYTES if size is None else size):
        return _to_all(fact, dim, on, "left")
    salted = fact.withColumn("_salt", _salt(fact, salts))
    copies = salted.select(*on, "_salt").distinct().join(dim, list(on), "left")
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def _to_all(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    return fact.join(F.broadcast(dim), list(on), how)


def _salt(df: DataFrame, salts: int):
    """From the row's own values, so that it is the same when a lost task runs again.
    Spark hashes every type but maps (and variants), which go in as JSON."""
    own = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in df.dtypes]
    return F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer splits than the cluster has cores
    over all cores, ahead of CPU-heavy parsing. A larger table is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
