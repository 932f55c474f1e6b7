"""Documents whose sets of word shingles are similar, as classes of linked documents.

Two documents link when ``den * intersection >= num * union``. No link is lost:

1. Equal sets become one node (a grouped minimum).
2. Linked sets differ in few elements, so of enough parts of the hash range some
   hold the same shingles in both. The parts' sums are signatures; nodes with a
   common signature are candidates of each other. Signatures are combined within
   each task before the shuffle, and emitted as stars, so a group of any size
   sends one row per node and task.
3. Each class of candidates is joined exactly by signature trees. Their nodes
   hold the OR of token bitmaps and the range of set sizes; pairs of nodes are
   walked down together and given up when the largest possible overlap is too
   small. Large classes are cut into chunks that share a pivot; what a pivot
   doesn't link is compared with every chunk.

Shingles shared by more than a small part of the documents are left out of step
2: what remains still differs in no more elements. A set with too little left has
signatures over all its shingles besides, by which it meets others of its kind;
it meets the rest by what it has left, so step 2 stays complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U64, byte_class, gram_hashes, mix, text_groups, word_hashes, words
from .tables import components, may_be_among, shared_dir, stored

WORD = byte_class((0x09, 0x0D), (0x20, 0x20))
CLASS_RATIO = 1.4
FLUSH = 500_000
CHUNK_DOCS, CHUNK_TOKENS = 1500, 1_000_000
LEAF, FAN, BITS = 32, 8, 1024
#: Documents in which common shingles are counted: those whose hash falls into this share.
COMMON_SHARE = 16
COMMON_LEAST, COMMON_RATE, COMMON_MOST = 8, 1 / 2000, 1 << 20


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle."""
    for _, _, data, offs in text_groups(column):
        data = LOWER[data]
        starts, ends, first = words(data, offs, WORD)
        hashes = word_hashes(data, starts, ends)
        grams = gram_hashes(hashes, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a:b - k + 1])
            else:
                yield gram_hashes(hashes[a:b], b - a) if b > a else np.empty(0, U64)


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two signed numbers."""
    pair = np.array([mix(tokens ^ U64(s)).sum(dtype=U64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]) + U64(len(tokens))
    a, b = mix(pair).view(np.int64).tolist()
    return a, b


class Signatures:
    """The signatures of sets for one similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops: list[int] = []

    def _class(self, c: int) -> tuple[int, int, int, int]:
        """Largest size, parts, parts that may be low, and the count up to which a part is low."""
        top = self.tops[c]
        differ = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if not differ:
            return top, 1, 0, 0
        least = (self.tops[c - 1] if c else 0) + 1
        for low in (1, 0):
            for spare in range(1, differ + 2):
                parts = differ + 1 + spare
                load = least / parts
                chance = math.exp(-load) * (1 + load * low)
                if parts * chance + 3 * math.sqrt(parts * chance) <= spare and spare <= 0.35 * parts:
                    return top, parts, spare, low
        return top, differ + 2, 1, 0

    def classes(self, size: int) -> list[tuple[int, int, int, int, int]]:
        """The size classes in which a set looks for others."""
        while not self.tops or self.tops[-1] < size:
            self.tops.append(max(len(self.tops) + 1, int((self.tops[-1] if self.tops else 0) * CLASS_RATIO)))
        c = int(np.searchsorted(self.tops, size))
        found = [c]
        while c > 0 and self.num * size <= self.den * self.tops[c - 1]:
            c -= 1
            found.append(c)
        return [(c, *self._class(c)) for c in found]

    def of(self, tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The signatures of a set, given the sorted hashes of common shingles.

        Linked sets agree in more than ``spare`` parts. If one has no more low
        parts than that, one of these is not low, and both emit it in family 1.
        If both have more, both are in family 2 whether or not they hold a
        common shingle. Without common shingles the families are the same.
        """
        rare = tokens
        if len(common):
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            rare = tokens[common[at] != tokens]
        out = []
        for c, _, parts, spare, low in self.classes(len(tokens)):
            few, lows, own = self._family(rare, c, parts, spare, low, 1)
            if few and len(common):
                out.append(own[~lows])
                few, lows, own = self._family(tokens, c, parts, spare, low, 2)
            out.append(own if few else own[~lows])
        return np.concatenate(out)

    def _family(self, tokens: np.ndarray, c: int, parts: int, spare: int, low: int, family: int) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether more than ``spare`` parts are low, which are, and the signatures of all."""
        borders = np.searchsorted(tokens, (np.arange(1, parts, dtype=np.uint64) * U64(((1 << 64) - 1) // parts)))
        borders = np.concatenate([[0], borders, [len(tokens)]])
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens), dtype=U64)])
        count = np.diff(borders)
        where = np.arange(parts, dtype=np.uint64) + U64((c << 8 | family) << 40)
        own = mix(mix(where) + (sums[borders[1:]] - sums[borders[:-1]]) * U64(0x9E3779B97F4A7C15) + count.astype(U64))
        lows = count <= low
        return bool(lows.sum() > spare), lows, own


class Classes:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def join_sets(sets: list[np.ndarray], num: int, den: int, classes: Classes, side: np.ndarray | None = None) -> None:
    """Join the classes of all similar sets (with ``side``: of sets on different sides).

    Pairs that are in one class already are not compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, tokens, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[tokens] > 1
    tokens, owner = tokens[shared], owner[shared]
    if not len(tokens):
        return
    kept = np.bincount(owner, minlength=len(sets))
    offs = np.concatenate([[0], np.cumsum(kept)])
    lowest = np.full(len(sets), flat.size, np.int64)
    some = np.flatnonzero(kept)
    lowest[some] = tokens[offs[some]]
    order = some[np.lexsort((sizes[some], lowest[some]))]
    leaves = [order[at:at + LEAF] for at in range(0, len(order), LEAF)]
    ids = [np.concatenate([tokens[offs[d]:offs[d + 1]] for d in leaf]) for leaf in leaves]
    own = [np.unique(x) for x in ids]
    for a, b in _leaf_pairs(leaves, tokens, offs, sizes, kept, num, den):
        left, right = leaves[a], leaves[b]
        roots = {classes.root(int(i)) for i in left} | {classes.root(int(j)) for j in right}
        if len(roots) == 1:
            continue
        both = own[a] if a == b else np.intersect1d(own[a], own[b], assume_unique=True)
        overlap = np.zeros((len(left), len(right)))
        for at in range(0, len(both), 1 << 16):
            some = both[at:at + (1 << 16)]
            x = _presence(some, ids[a], kept[left])
            overlap += x @ (x if a == b else _presence(some, ids[b], kept[right])).T
        union = sizes[left][:, None] + sizes[right][None, :] - overlap
        linked = (den * overlap >= num * union) & (overlap > 0)
        if a == b:
            linked = np.triu(linked, 1)
        if side is not None:
            linked &= side[left][:, None] != side[right][None, :]
        for i, j in np.argwhere(linked).tolist():
            classes.join(int(left[i]), int(right[j]))


def _presence(vocabulary: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), len(vocabulary)), np.float32)
    at = np.minimum(np.searchsorted(vocabulary, ids), len(vocabulary) - 1)
    hit = vocabulary[at] == ids
    out[np.repeat(np.arange(len(counts)), counts)[hit], at[hit]] = 1
    return out


def _leaf_pairs(leaves, tokens, offs, sizes, kept, num, den) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that the walk down the signature tree leaves over."""
    if len(leaves) == 1:
        yield 0, 0
        return
    bits = np.zeros((len(sizes), BITS), bool)
    bits[np.repeat(np.arange(len(sizes)), kept), tokens * 0x9E3779B1 % BITS] = True
    excess = kept - bits.sum(1)
    maps = np.packbits(bits, axis=1).view(np.uint64)
    levels = [tuple(np.stack(x) for x in zip(*[(np.bitwise_or.reduce(maps[d], 0), sizes[d].min(), sizes[d].max(), excess[d].max()) for d in leaves]))]
    while len(levels[-1][0]) > 1:
        m, lo, hi, ex = levels[-1]
        at = np.arange(0, len(m), FAN)
        levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
    pairs = np.zeros((1, 2), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        m, lo, hi, ex = levels[level]
        kept_pairs = [pairs[:0]]  # there may be no pair left, from any level on
        for at in range(0, len(pairs), 1 << 14):
            a, b = pairs[at:at + (1 << 14)].T
            most = np.bitwise_count(m[a] & m[b]).sum(1, dtype=np.int64) + np.minimum(ex[a], ex[b])
            alive = (num + den) * np.minimum(most, np.minimum(hi[a], hi[b])) >= num * (lo[a] + lo[b])
            alive &= (num * lo[a] <= den * hi[b]) & (num * lo[b] <= den * hi[a])
            kept_pairs.append(np.stack([a[alive], b[alive]], 1))
        pairs = np.concatenate(kept_pairs)
        if level:
            below = len(levels[level - 1][0])
            step = np.arange(FAN)
            a = (pairs[:, 0] * FAN)[:, None, None] + step[:, None] + 0 * step
            b = (pairs[:, 1] * FAN)[:, None, None] + step + 0 * step[:, None]
            a, b = a.ravel(), b.ravel()
            good = (a < below) & (b < below) & (a <= b)
            pairs = np.stack([a[good], b[good]], 1)
    # Nearest leaves first: most classes grow there, and later pairs are skipped.
    yield from pairs[np.argsort(pairs[:, 1] - pairs[:, 0], kind="stable")].tolist()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *set_hash(s)) if len(s) else (0, None, None) for s in shingle_sets(batch.column(1), k)]
            n, h, g = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64())], ["doc", "n", "h", "g"])

    return run


def _counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held or [np.empty(0, U64)]), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(t.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(1), k):
                held.append(s)
                size += len(s)
                if size > FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, the smallest node of each, and edges (node, smallest)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    heads = np.flatnonzero(new)
    low = node[heads][np.cumsum(new) - 1] if len(sig) else node
    apart = node != low
    edges = np.unique(np.stack([node[apart], low[apart]], 1), axis=0)
    return sig[heads], node[heads], edges


def _rows(sig: np.ndarray, low: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Signature rows (sig, a) and finished edges (any sig, a, b) in one table."""
    none = np.concatenate([np.ones(len(sig), bool), np.zeros(len(edges), bool)])
    other = np.concatenate([np.zeros(len(sig), np.int64), edges[:, 1]])
    return pa.record_batch(
        [pa.array(np.concatenate([sig.view(np.int64), edges[:, 0]])), pa.array(np.concatenate([low, edges[:, 0]])), pa.array(other, mask=none)], ["sig", "a", "b"])


def _signature_rows(k: int, num: int, den: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures(num, den)
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            if not held:
                return _rows(np.empty(0, U64), np.empty(0, np.int64), np.empty((0, 2), np.int64))
            nodes = np.fromiter(held, np.int64, len(held))
            out = _rows(*_stars(np.concatenate(list(held.values())), np.repeat(nodes, [len(x) for x in held.values()])))
            held.clear()
            return out

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (node := set_hash(s)[0]) in held:
                    continue
                held[node] = maker.of(s, common)
                size += len(held[node])
                if size > FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by signature; the last signature is carried over."""
    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.filter(batch.column(2).is_valid())
        open_ = batch.filter(batch.column(2).is_null())
        sig, node = (np.asarray(open_.column(i)) for i in (0, 1))
        edges = np.stack([np.asarray(done.column(1)), np.asarray(done.column(2)).astype(np.int64)], 1)
        if len(sig):
            if last is not None:
                sig, node = np.append([last[0]], sig), np.append([last[1]], node)
            keys, low, more = _stars(sig, node)
            edges = np.unique(np.concatenate([edges, more]), axis=0)
            end = int(np.searchsorted(keys, sig[-1]))
            last = int(sig[-1]), int(low[end])
        yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], k: int, keys: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows and shingle sets of each run of equal leading columns.

    The last three columns are the set's hash and the text; a text of another
    row with the same id has another hash and is left out.
    """
    rows: list[tuple] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        n = batch.num_columns - 3
        values = zip(*(batch.column(i).to_pylist() for i in range(n + 2)))
        for row, s in zip(values, shingle_sets(batch.column(n + 2), k)):
            if not len(s) or set_hash(s) != row[n:]:
                continue
            if rows and rows[-1][:keys] != row[:keys]:
                yield rows, sets
                rows, sets = [], []
            rows.append(row)
            sets.append(s)
    if rows:
        yield rows, sets


def _chunk_links(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _groups(batches, k, 2):
            classes = Classes(len(sets))
            join_sets(sets, num, den, classes)
            docs = [r[2] for r in rows]
            found = [(docs[i], docs[r]) for i in range(len(docs)) if (r := classes.root(i)) != i]
            if found:
                a, b = zip(*found)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _rest_links(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _groups(batches, k, 3):
            classes, seen = Classes(len(sets)), {}
            for i, row in enumerate(rows):
                classes.join(i, seen.setdefault(row[4], i))
            join_sets(sets, num, den, classes, np.array([row[3] for row in rows]))
            labels = [r[4] for r in rows]
            found = {(labels[i], labels[r]) for i in range(len(rows)) if labels[r := classes.root(i)] != labels[i]}
            if found:
                a, b = zip(*sorted(found))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def similar_documents(docs: DataFrame, words_each: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (set size), component_id
    (smallest doc_id reachable by links, itself included).

    A-Z are lower-cased; words are stretches without ASCII white space. A text of
    fewer than ``words_each`` words is one shingle; without words, or null, it
    has an empty set and links with nothing. A row without an id takes no part
    and has no component. Rows with one id are linked, each with its own set. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    sets = stored(source.mapInArrow(_sets(words_each), "doc long, n long, h long, g long"), folder)
    full = source.where("doc is not null and text is not null")

    sampled = full.where(F.pmod(F.xxhash64("doc"), F.lit(COMMON_SHARE)) == 0)
    least = max(COMMON_LEAST, int(COMMON_RATE * sets.where("h is not null").where(F.pmod(F.xxhash64("doc"), F.lit(COMMON_SHARE)) == 0).count()))
    common = sampled.mapInArrow(_counts(words_each), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(COMMON_MOST).toArrow()
    common = np.sort(np.asarray(common.column("token")).view(np.uint64))

    rows = full.select("text").mapInArrow(_signature_rows(words_each, num, den, common), "sig long, a long, b long")
    candidates = rows.repartition("sig").sortWithinPartitions("sig", "a").mapInArrow(_candidate_edges, "a long, b long").distinct()
    groups = stored(components(candidates), folder)

    reps = sets.where("h is not null and doc is not null").groupBy("h", "g").agg(F.min("doc").alias("rep"), F.max("n").alias("n"))
    members = stored(reps.join(groups, F.col("h") == F.col("node")).select(F.col("label").alias("comp"), "rep", "n", "h", "g"), folder)
    sizes = members.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.min("rep").alias("pivot")).where("docs > 1")
    sizes = stored(sizes, folder)
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("tokens") / CHUNK_TOKENS)).cast("int")
    members = members.join(sizes.select("comp", "pivot", chunks.alias("chunks")), "comp").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    members = stored(members, folder)

    # A pivot goes to all chunks of its class.
    whole = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    dealt = members.select("comp", F.explode(whole).alias("chunk"), "rep", "h", "g")
    links = stored(_with_text(dealt, full).repartition("comp", "chunk").sortWithinPartitions("comp", "chunk", "rep")
                   .select("comp", "chunk", "rep", "h", "g", "text").mapInArrow(_chunk_links(words_each, num, den), "a long, b long"), folder)
    labels = stored(components(links), folder)

    large = members.where("chunks > 1")
    if not large.isEmpty():
        named = large.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        heads = named.where("rep = pivot").select("comp", F.col("label").alias("head"))
        named = stored(named.join(heads, "comp"), folder)
        rest = named.where("label <> head")
        cuts = rest.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int").alias("cuts"))
        left = rest.join(cuts, "comp").select(
            "comp", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cuts")).cast("int").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "label", "rep", "h", "g")
        right = named.join(cuts, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "chunk", F.lit(1).alias("side"), "label", "rep", "h", "g")
        more = _with_text(left.unionAll(right), full).repartition("comp", "cut", "chunk").sortWithinPartitions("comp", "cut", "chunk", "side", "rep") \
            .select("comp", "cut", "chunk", "side", "label", "h", "g", "text").mapInArrow(_rest_links(words_each, num, den), "a long, b long")
        labels = stored(components(links.unionAll(more)), folder)

    # Stored, so that the join on a set that a third of the rows have is of two plain shuffles, which can be split.
    named = stored(reps.join(labels, F.col("rep") == F.col("node"), "left").select("h", "g", F.coalesce("label", "rep").alias("label")), folder)
    return sets.join(named, ["h", "g"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("label", "doc")).alias("component_id"))


def _with_text(members: DataFrame, full: DataFrame) -> DataFrame:
    """The texts of the representatives. They are merged by id at every size:
    how many documents have a candidate grows with the input. Texts of documents
    that have none stay where they are."""
    members = stored(members)
    texts = may_be_among(full.withColumnRenamed("doc", "rep"), members.select("rep").distinct(), "rep")
    return members.join(texts.hint("merge"), "rep")
