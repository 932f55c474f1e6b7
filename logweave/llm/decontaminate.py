"""Passages of benchmark items inside documents, found by winnowing.

Of the hashes of all runs of ``k`` words, the smallest of every ``window - k + 1``
consecutive ones is a fingerprint, so that every shared run of ``window`` words
has one on both sides. Fingerprints of documents that cannot be among the items' (by
a bitmap of these) stay in their task. The others are joined with the items'
fingerprints together with the window they stand for, which extends each hit to
the whole shared run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_dimension
from .arrays import LOWER, byte_class, gram_hashes, list_column, mix, text_groups, within, word_hashes, words
from .tables import carried, shared_dir, stored, with_text

WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
GRAM, WINDOW = 5, 10
#: Bits of the bitmap for each fingerprint of the items, and its bits at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
_PIECE = 1 << 15
#: Documents with hits, and hits, that are broadcast at most; more are joined by a shuffle.
FEW_DOCS, FEW_HITS = 100_000, 2_000_000

Windows = tuple[np.ndarray, np.ndarray, np.ndarray]


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside a document, and the fingerprint of each: its smallest run of ``k`` words."""
    grams = gram_hashes(hashes, k)
    width = window - k + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = grams[:n].copy()
    for o in range(1, width):
        np.minimum(low, grams[o:n + o], out=low)
    border = np.zeros(n + 1, np.int32)
    lo, hi = within(first, window)
    some = lo < hi
    np.add.at(border, lo[some], 1)
    np.add.at(border, hi[some], -1)
    at = np.flatnonzero(np.cumsum(border)[:n] > 0)
    return at, low[at]


def whole_runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` words inside a document, and the hash of each."""
    grams = gram_hashes(hashes, size)
    doc = np.searchsorted(first, np.arange(len(grams)), "right")
    at = np.flatnonzero(np.arange(len(grams)) + size <= first[np.minimum(doc, len(first) - 1)])
    return at, grams[at]


def _windows(hashes: np.ndarray, first: np.ndarray, size: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of windows of ``size`` words; short ones are their own fingerprint."""
    return fingerprints(hashes, first, k, size) if size == window else whole_runs(hashes, first, size)


def _hashed(column: pa.Array):
    for a, b, data, offs in text_groups(column):
        data = LOWER[data]
        starts, ends, first = words(data, offs, WORD)
        yield a, b, data, starts, ends, first, word_hashes(data, starts, ends)


def _check(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    """128 bits of a window's text."""
    return xxhash.xxh3_128_digest(b" ".join(data[s:e].tobytes() for s, e in zip(starts[at:at + size].tolist(), ends[at:at + size].tolist())))


def _places(keys: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A bit of the bitmap for windows of ``sizes`` words."""
    return (mix(keys + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)).astype(np.int64)


def _item_rows(window: int, k: int):
    """The windows of items: rows (size, print, check, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, starts, ends, first, hashes in _hashed(batch.column(1)):
                counts = np.diff(first)
                out: list[tuple] = []
                for size in np.unique(np.minimum(counts, window)).tolist():
                    if not size:
                        continue
                    at, keys = _windows(hashes, first, size, window, k)
                    item = np.searchsorted(first, at, "right") - 1
                    own = np.minimum(counts[item], window) == size
                    out += [(size, key, _check(data, starts, ends, p, size), a + i) for p, key, i in zip(at[own].tolist(), keys[own].view(np.int64).tolist(), item[own].tolist())]
                sizes, prints, checks, rows = zip(*out) if out else ((), (), (), ())
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.record_batch([pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(checks, pa.binary()), ids], ["size", "print", "check", "id"])

    return run


def _bit_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(0)), bits)
            yield pa.record_batch([pa.array(at)], ["at"])

    return run


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for every fingerprint of the items, and the sizes of their windows."""
    prints = windows.select("size", "print").distinct()
    bits = min(MOST_BITS, 1 << max(15, (BITS_EACH * max(prints.count(), 1) - 1).bit_length()))
    places = prints.mapInArrow(_bit_rows(bits), "at long")
    pieces = places.groupBy(F.expr(f"at div {_PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % _PIECE).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    for piece, part in pieces.collect():  # MOST_BITS bits at most
        whole[piece * _PIECE // 8:(piece + 1) * _PIECE // 8] = np.frombuffer(part, np.uint8)
    return whole, sorted(r[0] for r in windows.select("size").distinct().collect())


def _candidates(bitmap: np.ndarray, sizes: list[int], window: int, k: int):
    """Documents with their number of words and the windows whose fingerprint may be one of the items'."""
    bits = len(bitmap) * 8

    def may(keys: np.ndarray, size: int) -> np.ndarray:
        at = _places(keys, np.full(len(keys), size), bits)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for a, b, data, starts, ends, first, hashes in _hashed(batch.column(n)):
                found = []
                for size in sizes:
                    at, keys = _windows(hashes, first, size, window, k)
                    some = may(keys, size)
                    found.append((at[some], np.full(int(some.sum()), size, np.int32), keys[some].view(np.int64)))
                at, size, keys = (np.concatenate([np.empty(0, kind), *x]).astype(kind) for x, kind in zip(list(zip(*found)) or [(), (), ()], (np.int64, np.int32, np.int64)))
                order = np.argsort(at, kind="stable")
                at, size, keys = at[order], size[order], keys[order]
                checks = [_check(data, starts, ends, p, s) for p, s in zip(at.tolist(), size.tolist())]
                offs = pa.array(np.searchsorted(at, first).astype(np.int32))
                doc = np.searchsorted(first, at, "right") - 1
                lists = [pa.ListArray.from_arrays(offs, values) for values in (pa.array(at - first[doc]), pa.array(size), pa.array(keys), pa.array(checks, pa.binary()))]
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(np.diff(first), pa.int64()), *lists], [*batch.schema.names[:n], "n_words", "at", "size", "print", "check"])

    return run


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, k: int = GRAM, keep_text: bool = False) -> DataFrame:
    """The other columns of ``docs`` (with ``keep_text`` the text too) with n_words, hit_words
    (positions of words inside any occurrence of an item's window) and items (ids, sorted as text).

    A window is ``window`` consecutive words of an item; an item of fewer, but
    not none, is one window. Null texts have no words; items without id or words
    match nothing; ids that repeat count once. Documents are scanned once, however many
    items there are; the driver holds a bitmap of at most 32 MB. Columns named
    like the results are replaced.
    """
    folder = shared_dir(docs.sparkSession)
    inner, _, (item_id, item_text) = carried(items, (), item_id, item_text)
    own = inner.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    windows = stored(own.mapInArrow(_item_rows(window, k), "size int, print long, check binary, id string").distinct(), folder)
    bitmap, sizes = _bitmap(windows)

    source, _, kinds, back = with_text(docs, text, ("n_words", "hit_words", "items"), gone=not keep_text)
    scan = source.mapInArrow(_candidates(bitmap, sizes, window, k), f"{kinds}n_words long, at array<long>, size array<int>, print array<long>, check array<binary>")
    base = stored(scan.withColumn("row", F.monotonically_increasing_id()), folder)
    each = base.where(F.size("at") > 0).select("row", F.inline(F.arrays_zip("at", "size", "print", "check")))
    # The items' side has a row for each window and item; rows of a passage that many documents share are dealt by their salts.
    hits = stored(join_dimension(each, windows, ["size", "print", "check"]).select("row", "at", "size", "id"), folder)
    run = F.sequence("at", F.col("at") + F.col("size") - 1)
    found = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(run)))).alias("hit_words"), F.array_sort(F.collect_set("id")).alias("items"))
    n_docs, n_hits = hits.agg(F.count_distinct("row"), F.count("*")).first()
    few = n_docs <= FEW_DOCS and n_hits <= FEW_HITS
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    joined = base.join(F.broadcast(found) if few else found, "row", "left")
    return back(joined.withColumns({"hit_words": none("hit_words", "long"), "items": none("items", "string")}))
