"""A data-skipping index for text search over stored records.

Per file a bitmap of the hashed trigrams of all that a search looks at. A file that
lacks a trigram of the text sought cannot hold it and is not read; files without an
entry are read. So the answer is that of ``logs.search``, whatever the index holds.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import search, searched_text

#: Bits of a file's bitmap, in pieces of ``_PIECE`` bits as Spark builds them.
BITS = 1 << 19
_PIECE = 1 << 15
#: Characters of a text of which the trigrams are taken together.
_CUT = 64
#: Trigrams of a text sought that are looked up at most: more do not tell files apart any better.
MOST_GRAMS = 64


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def build_index(spark: SparkSession, records: str, index: str) -> None:
    """Write an entry for every file of ``records`` that has none yet: ``(file, piece,
    bits)``. Files do not change once they are written; new ones are added by another call."""
    df = spark.read.parquet(records)
    own = [c for c in df.columns if c in ("body", "attributes", "resource")]
    text = searched_text()
    texts = df.select("_metadata.file_path", *own).select("file_path", text.alias("text"))
    known = _entries(spark, index)
    if known is not None:
        texts = texts.join(F.broadcast(known.select(F.col("file").alias("file_path")).distinct()), "file_path", "left_anti")
    _bitmaps(texts).write.mode("append").parquet(index)


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``(file, piece, bits)`` of all trigrams in ``(file_path, text)``."""
    # Cut into short pieces that overlap by two characters: a trigram is found by counting characters from the start of its piece.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{3,{_CUT + 2}}})).{{1,{_CUT}}}"), F.lit(1))
    cut = texts.select(F.xxhash64("file_path").alias("_file"), F.explode(pieces).alias("text"))
    each = cut.select("_file", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 2)).alias("i"))
    # Of a file each bit once, by hashing, before anything is shuffled or sorted; long names join at the end. Of
    # names with equal hashes each has the bits of all, so that no file is left out.
    at = each.select("_file", _place(F.col("text").substr(F.col("i"), F.lit(3))).alias("at")).distinct()
    bits = at.groupBy("_file", F.expr(f"cast(at div {_PIECE} as int)").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % _PIECE).alias("bits"))
    names = texts.select(F.col("file_path").alias("file")).distinct().withColumn("_file", F.xxhash64("file"))
    return bits.join(names, "_file").select("file", "piece", "bits")


def _entries(spark: SparkSession, index: str) -> DataFrame | None:
    try:
        return spark.read.schema("file string, piece int, bits binary").parquet(index)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def files_without(spark: SparkSession, index: str, q: str) -> set[str]:
    """Files that cannot hold the text; none where it is shorter than a trigram."""
    entries, q = _entries(spark, index), q.lower()
    grams = sorted({q[i:i + 3] for i in range(len(q) - 2)})[:MOST_GRAMS]
    if entries is None or not grams or "\x00" in q:
        return set()
    tests = []
    for gram in grams:
        at = _place(F.lit(gram))
        byte = F.conv(F.hex(F.substring("bits", F.floor(at % _PIECE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        inside = F.col("piece") == F.floor(at / _PIECE)
        tests.append(F.coalesce(F.bool_or(inside & (F.getbit(byte, (at % 8).cast("int")) == 1)), F.lit(False)))
    whole = tests[0]
    for test in tests[1:]:
        whole = whole & test
    # A name for each file that is left out: as many as the file listing of the table itself.
    return {r["file"] for r in entries.groupBy("file").agg(whole.alias("may")).where("not may").select("file").collect()}


def _path(uri: str) -> str:
    """A file's path as it is written, from its URI; local ones come with one slash or three."""
    return re.sub(r"^file:/+", "file:/", unquote(uri))


def search_stored(spark: SparkSession, records: str, index: str, q: str) -> DataFrame:
    """``logs.search`` over a stored record table, reading only files that may hold the text."""
    whole = spark.read.parquet(records)
    skipped = {_path(f) for f in files_without(spark, index, q)}
    left = [f for f in map(_path, whole.inputFiles()) if f not in skipped]
    if not left:
        return search(whole.limit(0), q)
    some = spark.read.schema(whole.schema).option("basePath", records).parquet(*left) if skipped else whole
    return search(some, q)
