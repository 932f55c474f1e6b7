"""Tables of micro-batches in few folders.

Every batch writes one small folder, a run of level 0. ``fan`` runs of a level
are combined into one of the next, so that n batches lie in at most
``fan - 1`` folders a level and a row is rewritten once a level: what a batch
writes does not grow with what the table holds.

Which folders hold the batches before n follows from n alone (its digits to the
base ``fan``). Runs are only combined once all their batches are committed, and
are removed one batch later. So a batch that runs again, after a lost executor
or a restart, finds what it found before, and replaces what it had written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove

FAN = 8
#: Buckets of a table with one row per key. A fixed number: it is part of the layout.
BUCKETS = 64

Run = tuple[int, int]


def runs_before(n: int, fan: int = FAN) -> list[Run]:
    """The runs (level, number) that hold the batches 0 to n - 1, oldest first."""
    level = 0
    while fan ** (level + 1) <= n:
        level += 1
    out, at = [], 0
    for lv in range(level, -1, -1):
        while at + fan ** lv <= n:
            out.append((lv, at // fan ** lv))
            at += fan ** lv
    return out


def combined_at(n: int, fan: int = FAN) -> list[tuple[Run, list[Run]]]:
    """Runs that are combined when batch n starts, each with its parts; lower levels first."""
    out, level = [], 0
    while n and n % fan ** (level + 1) == 0:
        number = n // fan ** (level + 1) - 1
        out.append(((level + 1, number), [(level, number * fan + i) for i in range(fan)]))
        level += 1
    return out


class Runs:
    """A table under ``path`` with rows of ``schema``.

    ``combine(rows, whole)`` brings rows of several batches into the shape of one: it
    must not matter whether it is applied to parts first. ``whole`` says that the rows
    begin with batch 0. With ``bucket_by`` the rows are partitioned by a hash of
    that column; a batch writes the buckets it has rows for.
    """

    def __init__(self, path: str, schema: T.StructType, combine: Callable[[DataFrame, bool], DataFrame], bucket_by: str | None = None,
                 fan: int = FAN, buckets: int = BUCKETS):
        self.path, self.schema, self.combine, self.bucket_by, self.fan, self.buckets = path, schema, combine, bucket_by, fan, buckets

    def folder(self, run: Run) -> str:
        return f"{self.path}/level={run[0]}/run={run[1]:012d}"

    def begin(self, spark: SparkSession, n: int) -> None:
        """Combine what has become due before batch ``n``, and remove what was combined before batch n - 1."""
        for run, parts in combined_at(n, self.fan):
            self._save(self.combine(self._rows(spark, parts), run[1] == 0), run)
        for _, parts in combined_at(n - 1, self.fan) if n else []:
            for part in parts:
                remove(spark, self.folder(part))

    def before(self, spark: SparkSession, n: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the batches before ``n``, not combined; of some buckets only where these are given."""
        return self._rows(spark, runs_before(n, self.fan), buckets)

    def write(self, rows: DataFrame, n: int) -> None:
        """Write the rows of batch ``n``; from then on readers see it."""
        self._save(rows, (0, n))
        head = rows.sparkSession.createDataFrame([(n,)], "batch long").coalesce(1)
        head.write.mode("overwrite").parquet(f"{self.path}/head/batch={n}")
        remove(rows.sparkSession, f"{self.path}/head/batch={n - 2}")

    def newest(self, spark: SparkSession) -> DataFrame:
        """All rows so far, combined. None where no batch was written."""
        try:
            files = spark.read.parquet(f"{self.path}/head").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.schema)
        n = max(int(re.search(r"/batch=(\d+)/", f)[1]) for f in files)
        return self.combine(self._rows(spark, [*runs_before(n, self.fan), (0, n)]), True)

    def _rows(self, spark: SparkSession, runs: list[Run], buckets: list[int] | None = None) -> DataFrame:
        if not runs or buckets == []:
            return spark.createDataFrame([], self.schema)
        inside = T.StructType([*self.schema.fields, *([T.StructField("bucket", T.IntegerType())] if self.bucket_by else [])])
        rows = spark.read.schema(inside).option("basePath", self.path).parquet(*[self.folder(r) for r in runs])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*self.schema.names)

    def _save(self, rows: DataFrame, run: Run) -> None:
        rows = rows.select(*self.schema.names)
        if not self.bucket_by:
            rows.write.mode("overwrite").parquet(self.folder(run))
            return
        # One shuffle by bucket: a file per bucket, in the order of the key.
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", self.bucket_by)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self.folder(run))

    def bucket(self):
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")


def newest_by(key: str, order: str, gone: str) -> Callable[[DataFrame, bool], DataFrame]:
    """Combine by keeping the row of the highest ``order`` of each key. Rows
    marked ``gone`` hide what was before them and are left out where nothing was."""
    def combine(rows: DataFrame, whole: bool) -> DataFrame:
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")
        return last.where(~F.col(gone)) if whole else last

    return combine


def added_up(keys: list[str], counts: list[str]) -> Callable[[DataFrame, bool], DataFrame]:
    """Combine by adding up ``counts`` for each of the ``keys``; nulls are keys too."""
    return lambda rows, whole: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
