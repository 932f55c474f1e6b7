"""Byte-level BPE with a rank file, encoding and decoding.

The merges of a piece run on a segment tree over its byte positions whose root
is the leftmost pair of smallest rank. A merge updates the three positions it
touches, so a piece of n bytes costs n log n however long it is. Short pieces
of a batch share one set of array operations, one tree each.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Cache, keep
from .tables import carried, with_text

CACHE_PIECES = 80_000
SHORT = 128
_NONE = np.int64(1) << 62


class Ranks:
    """The vocabulary of a rank file, in the forms the merges need."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.tokens: list[bytes | None] = [None] * (max(self.ids.values()) + 1)
        for t, r in self.ids.items():
            self.tokens[r] = t
        self.split = regex.compile(pattern)
        self.cache = Cache(CACHE_PIECES)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs of tokens that are a token together, and its rank."""
        keys, found = array("q"), array("q")
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                if (a := self.ids.get(token[:i])) is not None and (b := self.ids.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        keys, found = np.array(keys), np.array(found)
        order = np.argsort(keys)
        return keys[order], found[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, found = self.pairs
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, found[at], _NONE >> 24)

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        worst = (1 << 40, size)
        tree = [worst] * (2 * size)
        for i in range(n - 1):
            if (r := self.ids.get(self.tokens[ids[i]] + self.tokens[ids[i + 1]])) is not None:
                tree[size + i] = (r, i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int) -> None:
            r = self.ids.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]]) if ids[i] >= 0 and after[i] < n else None
            node = size + i
            tree[node] = worst if r is None else (r, i)
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1][0] < worst[0]:
            r, i = tree[1]
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [t for t in ids if t >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of short pieces, each as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        size = 2
        while size <= SHORT:
            own = np.flatnonzero((lengths <= size) & (lengths > size // 2) if size > 2 else lengths <= size)
            for at in range(0, len(own), max(1, (1 << 20) // size)):
                some = own[at:at + max(1, (1 << 20) // size)]
                for i, ids in zip(some, self._merge_rows([pieces[i] for i in some], lengths[some], size)):
                    out[i] = ids
            size *= 2
        return out

    def _merge_rows(self, pieces: list[bytes], n: np.ndarray, size: int) -> list[bytes]:
        rows = len(pieces)
        pad = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        pos = np.arange(size)
        ids = np.where(pos < n[:, None], self.single[pad], -1)
        after, before = np.tile(pos + 1, (rows, 1)), np.tile(pos - 1, (rows, 1))
        tree = np.full((rows, 2 * size), _NONE)
        pairs = pos[:-1] + 1 < n[:, None]
        r = np.where(pairs, self.rank(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), _NONE >> 24)
        tree[:, size:2 * size - 1] = np.where(r < _NONE >> 24, r * size + pos[:-1], _NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(row: np.ndarray, i: np.ndarray) -> None:
            live = ids[row, i] >= 0
            j = after[row, i]
            live &= j < n[row]
            j = np.minimum(j, size - 1)
            r = self.rank(np.maximum(ids[row, i], 0), np.maximum(ids[row, j], 0))
            node = size + i
            tree[row, node] = np.where(live & (r < _NONE >> 24), r * size + i, _NONE)
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while len(row := np.flatnonzero(tree[:, 1] < _NONE)):
            r, i = np.divmod(tree[row, 1], size)
            j = after[row, i]
            ids[row, i], ids[row, j] = r, -1
            k = after[row, j]
            after[row, i] = k
            more = k < n[row]
            before[row[more], k[more]] = i[more]
            put(row, j)
            put(row, i)
            b = before[row, i]
            more = b >= 0
            if more.any():
                put(row[more], b[more])
        live = ids >= 0
        flat = ids[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: list[str]) -> None:
        """Put the tokens of new pieces into the cache."""
        short = []
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if raw in self.ids:
                self.cache[piece] = self.ids[raw].to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((piece, raw))
            else:
                self.cache[piece] = np.array(self.merge(raw), "<u4").tobytes()
        self.cache.update(zip((p for p, _ in short), self.merge_many([r for _, r in short])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text as little-endian 32-bit integers."""
        parts = [self.split.findall(t) for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        self.learn(self.cache.missing(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_loaded: dict[tuple[str, str], Ranks] = {}


def ranks(path: str, pattern: str) -> Ranks:
    """The vocabulary, read once per Python process; scans of another kind drop it with all pieces learnt."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
        keep(_loaded.clear)
    return _loaded[path, pattern]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``limit`` characters of text, or one row."""
    sizes = batch.column(column).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]) if len(sizes) else np.empty(0)
    sums = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        start = sums[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sums, start + limit, "right")))
        yield first, last
        first = last


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``ids``, the tokens of each whole text.

    Each match of ``pattern`` is encoded for itself, without special tokens; what
    it does not match has no tokens. A null or empty text has none. A column
    named ``ids`` is replaced; rows that repeat are encoded each.
    """
    source, rest, kinds, back = with_text(docs, text, ("ids",), gone=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks(path, pattern)
        for batch in batches:
            for first, last in text_slices(batch, len(rest)):
                part = batch.slice(first, last - first)
                codes = own.encode(part.column(len(rest)).fill_null("").to_pylist())
                offs = np.zeros(len(codes) + 1, np.int32)
                np.cumsum([len(c) // 4 for c in codes], out=offs[1:])
                flat = np.frombuffer(b"".join(codes), "<i4")
                yield pa.record_batch([*part.columns[:len(rest)], pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], [*rest, "ids"])

    return back(source.mapInArrow(run, f"{kinds}ids array<int>"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` with ``decoded``, the bytes of the token ids.

    A null list gives null; an id outside the vocabulary fails the job. A column
    named ``decoded`` is replaced.
    """
    inner, back, (ids,) = carried(tokens, ("decoded",), ids)
    rest = [c for c, name in zip(inner.columns, tokens.columns) if name.lower() != "decoded" or c == ids]
    source = inner.select(*rest)
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = ranks(path, pattern).tokens.__getitem__
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out = [None if not x.is_valid else b"".join(map(get, x.values.to_numpy(zero_copy_only=False).tolist())) for x in part.column(at)]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*rest, "decoded"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema)
    return back(source.mapInArrow(run, f"{kinds}decoded binary"))
