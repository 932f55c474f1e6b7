"""Vectors of high cosine, found by quantised random projections.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. A table's key is a run of
projections on normal directions, shifted and cut into cells (a p-stable hash for
the Euclidean distance); vectors that share a key in some table are compared
exactly. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix
from .jaccard_join import Classes
from .tables import components, shared_dir, stored

CELL = 2.0
RECALL = 0.999
BLOCK = 1024
_PAIRS = 4096
_BUCKET = ("bucket", "tab", "i", "j")
_SCALE, _STEPS = float(1 << 20), float(1 << 12)


def collision(distance: float, cell: float = CELL) -> float:
    """The chance that one projection puts two vectors at a distance into one cell."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Projections per table, so that unrelated vectors seldom meet among ``n``,
    and tables, so that a pair just at the cosine meets with chance ``RECALL``."""
    each = max(4, 2 + math.ceil(math.log(max(n, 2)) / -math.log(collision(math.sqrt(2)))))
    hit = collision(math.sqrt(2 - 2 * cosine)) ** each
    return each, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


class Tables:
    """The keys of vectors in all tables.

    Vectors and directions are rounded to integers, so that every sum is exact
    and a vector has the same keys wherever they are worked out.
    """

    def __init__(self, each: int, tables: int, seed: int = 3):
        self.each, self.tables, self.seed = each, tables, seed
        self.directions: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The keys of some or all tables, one column each."""
        dim, last = x.shape[1], self.tables if last is None else last
        if dim not in self.directions:
            rng = np.random.Generator(np.random.PCG64([self.seed, dim]))
            r = np.rint(rng.standard_normal((dim, self.each * self.tables)) * _STEPS)
            self.directions[dim] = r, np.rint(rng.random(self.each * self.tables) * CELL * _SCALE * _STEPS)
        r, shift = (d[..., first * self.each:last * self.each] for d in self.directions[dim])
        cells = np.floor((np.rint(x * _SCALE) @ r + shift) / (CELL * _SCALE * _STEPS)).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(x), last - first, self.each)
        key = np.broadcast_to(mix(np.arange(first, last, dtype=np.uint64) + U64(dim << 32)), cells.shape[:2]).copy()
        for i in range(self.each):
            key = mix(key * U64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key

    def apart_before(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, tab: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) of rows of ``x`` meet in none of the tables before ``tab``.

        Close pairs meet in one of the first tables, so these are looked at a few at a time,
        for the rows whose pairs are left.
        """
        open_, out, first, width = np.flatnonzero(tab > 0), tab == 0, 0, 4
        while len(open_):
            last = min(int(tab[open_].max()), first + width)
            rows, at = np.unique(np.concatenate([a[open_], b[open_]]), return_inverse=True)
            keys = self.keys(x[rows], first, last)
            met = (keys[at[:len(open_)]] == keys[at[len(open_):]]) & (np.arange(first, last) < tab[open_, None])
            open_ = open_[~met.any(1)]
            out[open_[tab[open_] <= last]] = True
            open_ = open_[tab[open_] > last]
            first, width = last, width * 2
        return out


def _normal(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes with a 128-bit hash; the others have nulls."""
    import xxhash

    for batch in batches:
        blobs, keys = [], []
        for v in batch.column(1):
            x = None if not v.is_valid or not len(v) or v.values.null_count else np.asarray(v.values, np.float64) + 0.0
            good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
            blobs.append(x.tobytes() if good else None)
            keys.append(xxhash.xxh3_128_digest(blobs[-1]) if good else None)
        pairs = [np.frombuffer(k, np.int64).tolist() if k else (None, None) for k in keys]
        yield pa.record_batch([batch.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(blobs, pa.binary())], ["vec_id", "h", "g", "vec"])


def _by_width(blobs: list[bytes]) -> Iterator[np.ndarray]:
    widths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for w in np.unique(widths):
        yield np.flatnonzero(widths == w)


def _bucket_rows(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, blobs = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for rows in _by_width(blobs):
                for at in range(0, len(rows), 512):
                    some = rows[at:at + 512]
                    keys = tables.keys(_normal([blobs[i] for i in some]))
                    yield pa.record_batch(
                        [pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables.tables, dtype=np.int32), len(some))), pa.array(np.repeat(reps[some], tables.tables))],
                        ["bucket", "tab", "rep"])

    return run


#: Buckets of as many rows at most are compared by shifting the rows against each other; larger ones by a matrix product.
SMALL = 12


def _bucket_links(tables: Tables, cosine: float):
    def close_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one bucket with a cosine of at least ``cosine``."""
        group = np.repeat(np.arange(len(starts)), ends - starts)
        small = np.repeat(ends - starts <= SMALL, ends - starts)
        pairs = []
        for o in range(1, SMALL):
            a = np.flatnonzero((group[o:] == group[:-o]) & small[o:])
            if not len(a):
                break
            pairs += [(a[at:at + _PAIRS], a[at:at + _PAIRS] + o) for at in range(0, len(a), _PAIRS)]
        pairs = [(a[c], b[c]) for a, b in pairs if (c := np.einsum("ij,ij->i", x[a], x[b]) >= cosine).any()]
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            if hi - lo > SMALL:
                a, b = np.nonzero(np.triu(x[lo:hi] @ x[lo:hi].T >= cosine, 1))
                pairs.append((a + lo, b + lo))
        return tuple(np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*pairs) if pairs else ((), ())))

    def links(batch: pa.RecordBatch) -> tuple[np.ndarray, ...] | None:
        """Of whole buckets of vectors of one width: rows with links, how many, and one they are linked to."""
        tab, i, j, block, reps, weights = (np.asarray(batch.column(c)) for c in ("tab", "i", "j", "block", "rep", "n"))
        x = _normal(batch.column("vec").to_pylist())
        starts, ends = _borders(batch)
        a, b = close_pairs(x, starts, ends)
        some = (i[a] == j[a]) | (block[a] != block[b])
        a, b = a[some], b[some]
        if not len(a):
            return None
        first = tables.apart_before(x, a, b, tab[a].astype(np.int64))  # a pair counts in the first table where it meets
        a, b = a[first], b[first]
        classes = Classes(len(reps))
        for p, q in zip(a.tolist(), b.tolist()):
            classes.join(p, q)
        degree = np.bincount(a, weights[b], len(reps)) + np.bincount(b, weights[a], len(reps))
        some = np.flatnonzero(degree)
        return reps[some], degree[some].astype(np.int64), reps[[classes.root(int(r)) for r in some]] if len(some) else reps[:0]

    def by_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A bucket has vectors of one width, but for hashes that happen to be equal."""
        for rows in _by_width(batch.column("vec").to_pylist()):
            yield batch.take(pa.array(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last bucket, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, _ = _borders(batch)
            key = [batch.column(c)[0] for c in _BUCKET]
            if held and [held[0].column(c)[0] for c in _BUCKET] == key:
                starts = starts[1:]
            cut = int(starts[-1]) if len(starts) else 0
            if len(starts):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
                yield from _packed([links(p) for w in whole for p in by_width(w)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _packed([links(p) for w in pa.Table.from_batches(held).combine_chunks().to_batches() for p in by_width(w)])

    return run


def _borders(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets start and end."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in _BUCKET:
        own = np.asarray(batch.column(c))
        new[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], batch.num_rows)


def _packed(found: list) -> Iterator[pa.RecordBatch]:
    found = [f for f in found if f is not None]
    if found:
        yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["rep", "links", "root"])


def linked_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable), kept.

    Vectors link when they meet in a table and their cosine in double precision
    is at least ``cosine``. Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of different length.
    Rows with one id count once as a partner. A row without an id takes no part
    and has no component. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    clean = stored(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_clean, "vec_id long, h long, g long, vec binary"), folder)
    usable = clean.where("h is not null and vec_id is not null")
    classes = stored(usable.select("vec_id", "h", "g").distinct().groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), folder)
    blobs = usable.select(F.col("vec_id").alias("rep"), "h", "g", "vec").dropDuplicates(["rep", "h", "g"])
    reps = stored(classes.join(blobs, ["rep", "h", "g"]).select("rep", "n", "vec"), folder)
    tables = Tables(*plan(classes.count(), cosine))

    rows = stored(reps.select("rep", "vec").mapInArrow(_bucket_rows(tables), "bucket long, tab int, rep long"), folder)
    full = rows.groupBy("bucket", "tab").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    block = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(full, ["bucket", "tab"]).withColumn("block", block).withColumn("other", other) \
        .select("bucket", "tab", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    placed = dealt.join(reps, "rep").select("bucket", "tab", "i", "j", "block", "rep", "n", "vec")
    found = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "tab", "i", "j", "rep").mapInArrow(_bucket_links(tables, cosine), "rep long, links long, root long")
    found = stored(found, folder)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left") \
        .select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    out = clean.drop("vec").join(named, ["h", "g"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("label", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
