"""Array kernels shared by the text operators: words and their hashes from Arrow columns.

All of them work on the UTF-8 bytes of a bounded group of documents at a time,
so the memory of a task follows the group (or one larger document), not its
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GROUP_BYTES = 2 << 20
_ROWS = 1000
_SEGMENT = 1 << 20
_STEP = U64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: What an operator keeps in a Python process from task to task, as functions that drop it.
_kept: list[Callable[[], None]] = []


def keep(drop: Callable[[], None]) -> None:
    """Say how to drop what is kept from task to task: an operator of another kind in the same process does."""
    _kept.append(drop)


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that belong to words: all but the given ranges."""
    table = np.ones(256, bool)
    for lo, hi in outside:
        table[lo:hi + 1] = False
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their bytes: (first, last, bytes, offsets).

    Nulls are empty. A range holds at most ``limit`` bytes, or one row.
    """
    while _kept:
        _kept.pop()()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), _ROWS):
        part = column.slice(at, _ROWS).cast(pa.large_string()).fill_null("")
        n = len(part)
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, np.int64)[part.offset:part.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
            yield at + first, at + last, raw[offs[first]:offs[last]], offs[first:last + 1] - offs[first]
            first = last


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the first word of each document.

    ``first`` has one entry more than there are documents; ``cuts`` marks bytes
    at which a new word starts in any case.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[data]
    border = np.zeros(n + 1, bool)
    if cuts is not None:
        border[:n] = cuts
    border[offs] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | border[1:n]
    end[:-1] &= ~w[1:] | border[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        base = 0xD1342543DE82EF95
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            table = np.full(n, U64(b))
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        span = data[base:ends[j - 1]]
        up, down = _power_tables(max(_SEGMENT, len(span) + 1))
        sums = np.zeros(len(span) + 1, U64)
        np.cumsum(_BYTE[span] * up[:len(span)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, over document borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    x = mix(hashes[:n] + U64(k))
    for i in range(1, k):
        x = mix(x * _STEP + hashes[i:n + i])
    return x


def within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first run of ``k`` words of each document and the one after its last."""
    return first[:-1], np.maximum(first[1:] - (k - 1), first[:-1])


def list_column(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per array."""
    offs = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offs[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))


class Cache(dict):
    """Results by key, in two generations: once ``size`` are held, those not
    asked for until as many new ones have come are forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.before = size, {}

    def missing(self, keys: set) -> list:
        """The keys without a result; the others are present from now on."""
        if len(self) > self.size:
            self.before = dict(self)
            self.clear()
        out = []
        for key in keys.difference(self):
            if (value := self.before.get(key)) is None:
                out.append(key)
            else:
                self[key] = value
        return out
