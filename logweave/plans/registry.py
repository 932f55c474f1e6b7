"""Query registry and table access shared by the plan modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.joins import spread

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def query(oracle: str | None = None) -> Callable[[Job], Job]:
    """Register a job under its function name, with the SQL that checks it.

    ``{table}`` in the SQL stands for a driver table.
    """
    def wrap(job: Job) -> Job:
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = bare(oracle)
        return job

    return wrap


_SLOT = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def bare(sql: str) -> str:
    return _SLOT.sub(r"\1", sql)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def run_sql(spark: SparkSession, sf: str, sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Spark SQL over the tables it names as ``{table}``; no views are left behind."""
    frames = {name: prepare(table(spark, sf, name)) for name in set(_SLOT.findall(sql))}
    text = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\{" + _SLOT.pattern + r"\}", r"{\1}", text), **frames)


def run_spread(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """``run_sql`` with each small table dealt over all cores first."""
    return run_sql(spark, sf, sql, spread)
