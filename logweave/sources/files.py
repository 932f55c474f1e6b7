"""Log files as tables or streams of lines.

A stream reads each file once, when it first appears: files must be rotated or
immutable segments, and lines appended to a file already read are not seen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


# Punctuation that stays as it is in a file URI.
_PLAIN = "/=:@!$&'()+,;~-._"


def glob_regex(glob: str) -> str:
    """Regex on a file URI that matches what a path glob matches."""
    scheme, host, path = re.match(r"(?s)^(?:([a-zA-Z][\w+.-]*):)?(?://([^/]*))?(.*)$", glob).groups()
    out, i, depth = "", 0, 0
    while i < len(path):
        ch = path[i]
        if path.startswith("**", i):
            out, i = out + ".*", i + 1
        elif ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in path[i + 1:]:
            end = path.index("]", i + 1)
            out += "[" + path[i + 1:end].replace("\\", "\\\\").replace("!", "^", 1) + "]"
            i = end
        elif ch == "{":
            out, depth = out + "(?:", depth + 1
        elif ch == "}" and depth:
            out, depth = out + ")", depth - 1
        elif ch == "," and depth:
            out += "|"
        else:
            out += re.escape(ch if ch.isalnum() or ch in _PLAIN or ord(ch) > 127 else f"%{ord(ch):02X}")
        i += 1
    anchor = "" if path.startswith("/") else "(?:.*/)?"
    if host:
        return f"^{re.escape(scheme)}://{re.escape(host)}{out}$"
    return f"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?{anchor}{out}$"


def _any(path: Column, globs: Sequence[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream looks for a pattern anew in each batch, but
    fails at once where a plain path does not exist."""
    if re.search(r"[*?\[{]", path):
        return path
    return re.sub(r"([^/\\])(/*)$", r"[\1]\2", path)


def read_log_files(spark: SparkSession, include: Sequence[str], exclude: Sequence[str] = (), start_at: str = "end",
                   stream: bool = False, started: datetime | None = None, files_per_trigger: int | None = None,
                   receiver: str = "file_log", checkpoint: str | None = None) -> DataFrame:
    """Lines of files that match ``include`` but not ``exclude``.

    ``start_at='end'`` (the default) reads only files changed since ``started``
    (now, if not given); ``'beginning'`` reads all. With ``checkpoint`` the start
    is kept in a folder beside it, so that a stream that resumes reads what has
    arrived meanwhile; a stream from the end needs that folder or ``started``. A
    file that matches several patterns is read once; a pattern that matches
    nothing adds no lines, and in a stream is looked for in each batch, as is its
    folder. Columns: ``receiver, file_path, body``.
    """
    if start_at not in ("beginning", "end"):
        raise ValueError(f"start_at must be beginning or end, not {start_at!r}")
    if not include:
        raise ValueError("include needs at least one pattern")
    if stream and start_at == "end" and not (checkpoint or started):
        raise ValueError("a stream from the end needs its checkpoint folder, to resume where it began")
    since = started or datetime.now(timezone.utc)
    if checkpoint and start_at == "end":
        since = _kept_start(spark, f"{checkpoint.rstrip('/')}-started", since)
    out = None
    for i, pattern in enumerate(include):
        reader = spark.readStream if stream else spark.read
        reader = reader.option("lineSep", "\n")
        if stream and files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        path = F.col("_metadata.file_path")
        try:
            lines = reader.text(_as_glob(pattern) if stream else pattern)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_modification_time:timestamp>")
        lines = lines.filter(~_any(path, [*include[:i], *exclude]))
        if start_at == "end":
            lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
        lines = lines.select(F.lit(receiver).alias("receiver"), path.alias("file_path"),
                             F.regexp_replace("value", "\r$", "").alias("body"))
        out = lines if out is None else out.unionByName(lines)
    return out


def _kept_start(spark: SparkSession, folder: str, now: datetime) -> datetime:
    """The start written by the first run; ``now`` is written if there is none."""
    try:
        return spark.read.schema("start timestamp").parquet(folder).first()["start"].astimezone(timezone.utc)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([(now,)], "start timestamp").coalesce(1).write.parquet(folder)
    return now
