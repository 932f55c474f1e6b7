"""Token ids of documents in Parquet files, in the order of their ids.

A token set is a folder: ``data`` holds one row per document (part, doc_id,
offset, n_tokens, ids), files and rows in ascending doc_id order, with the
offset counted from the start of the part; ``parts`` holds one row per part with
its base offset. Ids are dictionary-encoded, the sorted number columns
delta-encoded (Parquet format 2). Row groups and pages are kept small enough
that the page index finds a few documents, and the metadata columns can be read
without touching the ids.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, byte_class, text_groups, word_hashes, words
from .tables import carried

#: Words that a worker knows before it starts anew.
CACHE_WORDS = 1_000_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000

BLANKS = byte_class((0x09, 0x0D), (0x20, 0x20))
_SMALL, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_SMALL[97:123] = True
_SIGN[[ord(c) for c in ".,!?;:"]] = True


class WordEncoder:
    """Ids from the tokenizers library, each distinct word looked up once.

    Holds for tokenizers that drop white space and lower the case, as
    ``word_bpe_49k.json`` does: the ids of a text are those of its stretches
    without white space, and the tokenizer starts a new word at a sign that
    follows a letter. What is known lies in arrays, by the sorted 64-bit hashes of
    words: their ids stand one after the other in ``flat``. Words that are not
    known go through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words that are not known; ``hashes`` are sorted."""
        ids, sizes = array("i"), array("i")
        for at in range(0, len(words), 20_000):
            for found in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[at:at + 20_000]], add_special_tokens=False):
                own = found.ids
                ids.extend(own)
                sizes.append(len(own))
        size = np.frombuffer(sizes, np.int32)
        at = np.searchsorted(self.hashes, hashes)
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.hashes, self.begin, self.size = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.flat = np.concatenate([self.flat, np.frombuffer(ids, np.int32)])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the words of sorted hashes are among those known; -1 for one that is not."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def encode(self, column: pa.Array, closing: bytes = b"") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row ranges of a text column: (first, last, ids in each text, all ids).

        ``closing`` is put at the end of each text.
        """
        end = np.frombuffer(closing, "<i4")
        for first_row, last_row, data, offs in text_groups(column):
            cuts = None
            if b"<|" not in data.tobytes():  # else a stretch may hold a special token, which has its own case
                data = LOWER[data]
                letter = _SMALL[data]
                letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
                cuts = np.zeros(len(data), bool)
                cuts[1:] = letter[:-1] & _SIGN[data[1:]]
            starts, ends, first = words(data, offs, BLANKS, cuts)
            distinct, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            place = self.places(distinct)
            if (fresh := place < 0).any():
                if len(self.hashes) > CACHE_WORDS:
                    self.forget()
                    fresh[:] = True
                self.learn(distinct[fresh], [data[s:e].tobytes() for s, e in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist())])
                place = self.places(distinct)
            where = place[which]
            counts = self.size[where].astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(counts)])
            # The ids of a word follow those of the words before; each document before adds an end.
            docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
            n_ids = sums[first[1:]] - sums[first[:-1]] + len(end)
            ids = np.empty(int(sums[-1]) + len(end) * (len(first) - 1), np.int32)
            source = np.repeat(self.begin[where] - sums[:-1], counts) + np.arange(sums[-1])
            if len(end):
                ids[np.repeat(docs * len(end), counts) + np.arange(sums[-1])] = self.flat[source]
                ids[(np.cumsum(n_ids) - len(end))[:, None] + np.arange(len(end))] = end
            else:
                ids = self.flat[source]
            yield first_row, last_row, n_ids, ids


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The tokenizer, read once per Python process."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, key: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encode the whole texts of ``docs`` and write them as a token set.

    ``end`` is appended to each document (None: nothing). A null text is empty.
    Rows are ordered by id, null ids first, then by text; rows that repeat are
    kept. An empty table gives an empty token set.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")) \
        .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    closing = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, offset = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, sizes, flat in own.encode(batch.column(1), closing):
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.append([0], ends).astype(np.int32)), pa.array(flat))
                yield pa.record_batch(
                    [pa.array(np.full(len(sizes), part, np.int32)), batch.column(0).slice(first, last - first), pa.array(offset + ends - sizes), pa.array(sizes), ids],
                    ["part", "doc_id", "offset", "n_tokens", "ids"])
                offset += int(ends[-1])

    tokens = ranged.mapInArrow(run, "part int, doc_id long, offset long, n_tokens long, ids array<int>")
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#offset": "false", "compression": "zstd",
    }
    tokens.write.options(**options).parquet(f"{folder}/data")
    sizes = spark.read.schema("part int, n_tokens long").parquet(f"{folder}/data").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # One row per part: a running sum over them is small whatever the documents hold.
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("part", base.alias("base"), "n_tokens").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents of a token set; only the columns asked for are read.

    ``start`` counts the ids of all documents before. Filters on doc_id reach
    the row groups and pages.
    """
    data = spark.read.schema("part int, doc_id long, offset long, n_tokens long, ids array<int>").parquet(f"{folder}/data")
    if "start" in columns:
        parts = spark.read.schema("part int, base long").parquet(f"{folder}/parts")
        data = data.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("offset"))
    return data.select(*columns)


def with_crc32(tokens: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace the column ``ids`` by the CRC-32 of its little-endian 32-bit integers; a null list has null."""
    inner, back, (ids,) = carried(tokens, (out,), ids, gone=(ids,))
    rest = [c for c, name in zip(inner.columns, tokens.columns) if c != ids and name.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            flat, offs = memoryview(np.ascontiguousarray(lists.values, "<u4")).cast("B"), (np.asarray(lists.offsets) * 4).tolist()
            sums = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(offs, offs[1:])], pa.int64(), mask=np.asarray(lists.is_null()))
            yield pa.record_batch([*batch.columns[:len(rest)], sums], [*rest, out])

    source = inner.select(*rest, ids)
    kinds = "".join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in rest)
    return back(source.mapInArrow(run, f"{kinds}{out} long"))
