"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents of like size, one bitmap per signature
bit: bit r of slice b says whether document r has bit b set. A document sets bits
for each of its terms, and more for a term that it holds twice, three times or five
times. The AND of a term's slices overestimates the documents that hold it so
often, and the sum of such bitmaps, weighted by what the term can add at most, is an
upper bound of each document's score. Documents whose bound is below the k-th best
exact score found so far are excluded; all others are scored from their texts.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .arrays import LOWER, byte_class, mix, text_groups, word_hashes, words
from .tables import carried, stored

WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Occurrences from which a term sets further bits.
LEVELS = (1, 2, 3, 5)
#: Bits a signature has for each of its entries, at least, and bits that an entry sets.
BITS, HASHES = 10, 4
#: Items of a block, and bytes of their texts; every block reads the index anew.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 1 << 20
#: Ids of documents to score that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
_CELLS = 1 << 22
_BILLION, _THOUSAND = 1_000_000_000, 1000


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with the hashes of their terms, and the first term of each row."""
    for a, b, data, offs in text_groups(column):
        data = LOWER[data]
        starts, ends, first = words(data, offs, WORD)
        yield a, b, word_hashes(data, starts, ends), first


def _counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (sorted) with the number of documents that hold each; and of every
    term in a document: the document, and how often."""
    known, term = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cells, times = np.unique(doc * max(len(known), 1) + term, return_counts=True)
    doc, term = np.divmod(cells, max(len(known), 1))
    return known, term, doc, times


def _bits(terms: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits that terms set at a level in signatures of ``width`` bits: one row per hash."""
    x = mix(terms + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) & np.uint64(width - 1) for i in range(HASHES)]).astype(np.int64)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, first in _hashed(batch.column(1)):
            known, term, doc, times = _counted(hashes, first)
            docs = b - a
            entries = np.zeros(docs, np.int64)
            for least in LEVELS:
                entries += np.bincount(doc[times >= least], minlength=docs)
            width = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(entries, 1) * BITS))).astype(np.int64)
            held = np.bincount(term, minlength=len(known)).astype(np.uint32)
            sizes = np.diff(first)
            rows = []
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                place = np.full(docs, -1)
                place[own] = np.arange(len(own))
                slices = np.zeros((w, -(-len(own) // 8)), np.uint8)
                for level, least in enumerate(LEVELS):
                    some = (place[doc] >= 0) & (times >= least)
                    row = place[doc[some]]
                    for at in _bits(known[term[some]], level, int(w)):
                        np.bitwise_or.at(slices, (at, row >> 3), (1 << (row & 7)).astype(np.uint8))
                ids = batch.column(0).slice(a, docs).take(pa.array(own))
                rows.append((ids, sizes[own], int(w), slices.tobytes(), b"" if rows else known.tobytes(), b"" if rows else held.tobytes()))
            for ids, n, w, slices, terms, counts in rows:
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([n], pa.list_(pa.int64())), pa.array([w], pa.int32()),
                     pa.array([slices], pa.binary()), pa.array([terms], pa.binary()), pa.array([counts], pa.binary())],
                    ["ids", "sizes", "width", "slices", "terms", "counts"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``: a row per block of documents of like size,
    with ids, numbers of terms and slices, and per group of blocks its distinct terms
    and how many documents hold each. Null texts have no terms."""
    inner, _, (key, text) = carried(docs, (), key, text)
    source = inner.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return stored(source.mapInArrow(_index_rows, f"ids array<{kind}>, sizes array<long>, width int, slices binary, terms binary, counts binary"))


class _Block:
    """A block of items, with the weights of its terms."""

    def __init__(self, items: list[list[int]], n_docs: int, n_terms: int, held: dict[int, int]):
        self.docs, self.terms = n_docs, n_terms
        counted = [sorted(Counter(own).items()) for own in items]
        self.known = np.array(sorted({t for own in counted for t, _ in own}), np.uint64)
        weight = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1)))) for t in self.known.tolist()], np.int64)
        self.items = len(items)
        self.item = np.repeat(np.arange(len(items)), [len(own) for own in counted])
        self.term = np.searchsorted(self.known, np.array([t for own in counted for t, _ in own], np.uint64))
        self.weight = weight[self.term] * np.array([c for own in counted for _, c in own], np.int64) if len(self.term) else np.empty(0, np.int64)
        self.starts = np.flatnonzero(np.diff(self.item, prepend=-1))
        order = np.argsort(self.term, kind="stable")
        self.by_term = order
        self.reach = np.searchsorted(self.term[order], np.arange(len(self.known) + 1))

    def dampings(self, sizes: np.ndarray) -> np.ndarray:
        """8 m of documents with so many terms."""
        return np.array([8 * (25 + 75 * int(n) * self.docs // self.terms) for n in sizes.tolist()], np.int64)

    def bounds(self, sizes: np.ndarray, width: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, scores at most, by item with terms and document) of a block of documents."""
        n = len(sizes)
        table = np.frombuffer(slices, np.uint8).reshape(width, -1)
        damp = self.dampings(sizes)
        most = [np.minimum(top, np.maximum(sizes, 1)) for top in (*(least - 1 for least in LEVELS[1:]), 1 << 32)]
        parts = [_BILLION * t // (_THOUSAND * t + damp) for t in most]
        steps = [parts[0], *(b - a for a, b in zip(parts, parts[1:]))]
        present = np.full((len(self.known), table.shape[1]), 255, np.uint8)
        levels = []
        for level in range(len(LEVELS)):
            for at in _bits(self.known, level, width):
                present &= table[at]
            levels.append(present.copy())
        each = max(8, _CELLS // max(len(self.term), 1) // 8 * 8)
        for a in range(0, n, each):
            b = min(n, a + each)
            worth = np.zeros((len(self.known), b - a), np.int64)
            for bits, step in zip(levels, steps):
                worth += np.unpackbits(bits[:, a // 8:-(-b // 8)], axis=1, count=b - a, bitorder="little") * step[a:b]
            yield a, np.add.reduceat(worth[self.term] * self.weight[:, None], self.starts, axis=0)

    def exact(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores by document and item."""
        docs = len(first) - 1
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        doc = np.repeat(np.arange(docs), np.diff(first))[hit]
        cells, times = np.unique(doc * len(self.known) + at[hit], return_counts=True)
        doc, term = np.divmod(cells, len(self.known))
        part = _BILLION * times // (_THOUSAND * times + self.dampings(np.diff(first))[doc])
        reach = self.reach[term + 1] - self.reach[term]
        own = np.repeat(np.arange(len(cells)), reach)
        pair = self.by_term[np.repeat(self.reach[term], reach) + np.arange(len(own)) - np.repeat(np.cumsum(reach) - reach, reach)]
        scores = np.zeros((docs, self.items), np.int64)
        np.add.at(scores, (doc[own], self.item[pair]), part[own] * self.weight[pair])
        return scores


class _Best:
    """The best rows of each item: highest score, then smallest id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        some = np.flatnonzero(scores >= self.least[item])
        if not len(some):
            return
        new = [(-s, i is None, i) for s, i in zip(scores[some].tolist(), ids.take(pa.array(some)).to_pylist())]
        self.rows[item] = heapq.nsmallest(self.k, self.rows[item] + new, key=lambda r: r[:2] if r[1] else r)
        if len(self.rows[item]) == self.k:
            self.least[item] = -self.rows[item][-1][0]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        flat = [(n, -r[0], r[2]) for n, own in enumerate(self.rows) for r in own]
        return pa.record_batch([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], kind)], ["item", "score", "id"])


def _bound_rows(block: _Block, k: int, least: np.ndarray | None):
    """Without ``least``: the rows of each task with the highest bounds by item.
    With it: ids of all documents whose bound reaches the least score of some item."""
    shown = block.item[block.starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(block.items, k), None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids, sizes = batch.column("ids")[r].values, np.asarray(batch.column("sizes")[r].values)
                for a, top in block.bounds(sizes, batch.column("width")[r].as_py(), batch.column("slices")[r].as_py()):
                    if least is None:
                        for item, scores in zip(shown.tolist(), top):
                            best.add(item, scores, ids.slice(a, top.shape[1]))
                    else:
                        some = np.flatnonzero((top >= least[shown][:, None]).any(0))
                        yield pa.record_batch([ids.take(pa.array(a + some))], ["id"])
        if least is None and kind is not None:
            yield best.batch(kind)

    return run


def _score_rows(block: _Block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(block.items, k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, hashes, first in _hashed(batch.column(1)):
                scores = block.exact(hashes, first)
                for item in np.flatnonzero((scores >= best.least).any(0)).tolist():
                    best.add(item, scores[:, item], batch.column(0).slice(a, b - a))
        if kind is not None:
            yield best.batch(kind)

    return run


def _held_rows(known: np.ndarray):
    """How many documents of each row's group hold each of the known terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                terms, counts = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
                    sums += np.where(terms[at] == known, counts[at], 0)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(sums[some])], ["term", "held"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """For each item its ``k`` documents of the highest score above 0: the item's id, rank, the document's id, score.

    Scores are whole numbers: over the item's terms, repeats included, a weight that falls
    with the documents that hold the term, times a share that grows with its occurrences
    and falls with the document's length. Of equal scores the smaller id is first, a null
    id last. A row that repeats is a document of its own. Items with the same id are one
    item with the terms of all their different texts; a null id is an id. Null and empty
    texts have no terms: such items have no rows, such documents never rank. Other
    columns are ignored. ``index`` is what ``build_index`` gave for the same documents.

    Items are taken in blocks; each reads the index twice, and the documents twice: once
    for a few of the highest bounds, from which the k-th best score is known to be at least
    so high, and once for all that may reach it.
    """
    spark = docs.sparkSession
    index = build_index(docs, key, text) if index is None else index
    names = item_id, "rank", key, "score"
    inner, _, (key, text) = carried(docs, (), key, text)
    docs = inner.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    inner, _, (item_id, item_text) = carried(items, (), item_id, item_text)
    asked = inner.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    id_type, item_type = docs.schema["id"].dataType, asked.schema["item_id"].dataType
    kind = id_type.simpleString()

    stats = index.agg(
        F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + if(n > 0, 1, 0))")).alias("docs"), F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)")).alias("terms")).first()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size[0] * 2 // BLOCK_BYTES), -(-size[1] * 2 // BLOCK_ITEMS))
    out = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(_text("item_id")), F.lit(blocks)) == b).collect()
        ids, terms = _items(rows)
        if not ids or not stats["terms"]:
            continue
        known = np.array(sorted({t for own in terms for t in own}), np.uint64)
        held = index.where(F.length("terms") > 0).select("terms", "counts").mapInArrow(_held_rows(known), "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
        block = _Block(terms, stats["docs"], stats["terms"], {int(known[r["term"]]): r["held"] for r in held.collect()})
        slices = index.select("ids", "sizes", "width", "slices")

        top = slices.mapInArrow(_bound_rows(block, k, None), f"item int, score long, id {kind}")
        seeds = _ranked(top, k).select("id").distinct()  # at most k for each of BLOCK_ITEMS items
        found = _ranked(_only(docs, seeds, True).mapInArrow(_score_rows(block, k), f"item int, score long, id {kind}"), k).where(F.col("rank") == k)
        least = np.ones(block.items, np.int64)
        for r in found.collect():
            least[r["item"]] = r["score"]
        reach = stored(slices.mapInArrow(_bound_rows(block, k, least), f"id {kind}"))
        few = reach.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        best = _only(docs, reach.distinct(), few).mapInArrow(_score_rows(block, k), f"item int, score long, id {kind}")
        labels = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", item_type)]))
        out.append(stored(_ranked(best, k).join(F.broadcast(labels), "item").select("item_id", "rank", "id", "score")))
    if not out:
        return asked.join(docs.select("id").limit(0), F.lit(True)).limit(0).select("item_id", F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).toDF(*names)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole.toDF(*names)


def _items(rows: list) -> tuple[list, list[list[int]]]:
    """Item ids and their terms, for items that have any."""
    by: dict = {}
    for a, b, hashes, first in _hashed(pa.array([r["text"] for r in rows], pa.string())):
        for r, lo, hi in zip(rows[a:b], first[:-1].tolist(), first[1:].tolist()):
            by.setdefault(r["item_id"], []).extend(hashes[lo:hi].tolist())
    return [i for i, t in by.items() if t], [t for t in by.values() if t]


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each item; a task sends that many of an item at most."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _text(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _only(docs: DataFrame, ids: DataFrame, small: bool) -> DataFrame:
    """Documents whose id is among ``ids``, as (id, text); null ids meet."""
    ids = ids.select(_text("id").alias("name"))
    return docs.withColumn("name", _text("id")).join(F.broadcast(ids) if small else ids, "name", "left_semi").select("id", "text")
