"""Session settings the jobs are written for."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "logweave", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the first
    comes from spark-submit, the second from adaptive coalescing.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master:
        builder = builder.master(master)
        settings |= {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote, on whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a job go when it ends, not when the driver happens to
    collect its garbage. A table that is read again is shuffled again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last ``version=n`` of a versioned table, told by the names of its folders."""
    last = max(int(re.search(r"/version=(\d+)/", f)[1]) for f in spark.read.parquet(path).inputFiles())
    return spark.read.parquet(f"{path}/version={last}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write to, for checkpoints and state tables:
    ``spark.checkpoint.dir``. Unset, it is a fresh local folder in local mode
    and an error on a cluster, where such a folder would not survive the loss
    of an executor."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="run-")
