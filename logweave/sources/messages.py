"""The agent message log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fleet import with_started_at
from ..schemas import AGENT_MESSAGE


def read_agent_messages(spark: SparkSession, path: str, stream: bool = False, format: str = "json",
                        files_per_trigger: int | None = None) -> DataFrame:
    """Messages in the declared shape; absent fields read as NULL, an absent start
    time as that of the snapshot."""
    reader = (spark.readStream if stream else spark.read).schema(AGENT_MESSAGE).format(format)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_started_at(reader.load(path))
