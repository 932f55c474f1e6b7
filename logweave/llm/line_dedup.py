"""Lines that several documents share stay only in the document with the smallest id.

Distinct line hashes found in two documents or more are dealt to shards. Each
shard is a minimal perfect hash over its hashes (levels of bit arrays) that
indexes compact arrays: fingerprint, number of documents, smallest document.
The hashes of a document's lines probe those arrays; lines are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, mix
from .tables import carried, shared_dir, stored

SHARD_KEYS = 1 << 16
PROBE_ROWS = 250_000
_GAMMA = 2.0
_LEVELS = 48


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """The key of a line, or None if it has fewer than ``least`` code points."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A minimal perfect hash over distinct 64-bit keys: (slot of each key, bit
    arrays of the levels, sorted keys that no level could place)."""
    slot = np.empty(len(keys), np.int64)
    left, levels, used = np.arange(len(keys)), [], 0
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, int(_GAMMA * len(left)))
        at = _place(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        slot[left[placed]] = used + rank[at[placed]]
        used += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    rest = np.sort(keys[left])
    slot[left] = used + np.searchsorted(rest, keys[left])
    return slot, levels, rest


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % U64(size)).astype(np.int64)


def find(keys: np.ndarray, levels: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that is not indexed gets any slot, or -1."""
    slot = np.full(len(keys), -1, np.int64)
    left, used = np.arange(len(keys)), 0
    for level, alone in enumerate(levels):
        at = _place(keys[left], level, len(alone))
        hit = alone[at]
        slot[left[hit]] = used + (np.cumsum(alone) - 1)[at[hit]]
        used += int(alone.sum())
        left = left[~hit]
    if len(rest) and len(left):
        at = np.minimum(np.searchsorted(rest, keys[left]), len(rest) - 1)
        hit = rest[at] == keys[left]
        slot[left[hit]] = used + at[hit]
    return slot


_INDEX = "shard long, sizes array<int>, bits binary, rest binary, fingerprints binary, counts binary, firsts binary"


def _shard_row(shard: int, rows: pd.DataFrame) -> dict:
    slot, levels, rest = build_index(rows["h"].to_numpy().astype(np.uint64))
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    take = lambda c, kind: rows[c].to_numpy()[order].astype(kind).tobytes()
    return {
        "shard": shard, "sizes": [len(x) for x in levels], "bits": b"".join(np.packbits(x).tobytes() for x in levels), "rest": rest.tobytes(),
        "fingerprints": take("f", np.int64), "counts": take("n_docs", np.int64), "firsts": take("first", np.int64),
    }


class Shard:
    """The arrays of one shard."""

    def __init__(self, row: dict):
        self.levels, at, bits = [], 0, np.frombuffer(row["bits"], np.uint8)
        for size in row["sizes"]:
            n = (size + 7) // 8
            self.levels.append(np.unpackbits(bits[at:at + n], count=size).astype(bool))
            at += n
        self.rest = np.frombuffer(row["rest"], np.uint64)
        self.fingerprints, self.counts, self.firsts = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "counts", "firsts"))

    def probe(self, h: np.ndarray, f: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which line hashes are indexed with a count of at least ``least``, and the smallest document of each."""
        slot = find(h.astype(np.uint64), self.levels, self.rest)
        known = slot >= 0
        known[known] = (self.fingerprints[slot[known]] == f[known]) & (self.counts[slot[known]] >= least)
        return known, np.where(known, self.firsts[np.where(known, slot, 0)], 0)


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, digests = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                if doc is None or not text:
                    continue
                keys = {_hash(k) for k in map(line_key, text.split(b"\n")) if k is not None}
                ids += [doc] * len(keys)
                digests += keys
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "h", "f"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_columns
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lines, dropped, kept = [], [], []
            for text, gone in zip(part.column(n - 2).cast(pa.large_binary()).to_pylist(), part.column(n - 1)):
                own = (text or b"").split(b"\n")
                stay = own
                if gone.is_valid and len(gone):
                    marks = set(gone.values.to_pylist())
                    stay = []
                    for line in own:
                        key = line_key(line)
                        if key is None or int.from_bytes(_hash(key)[8:], "little", signed=True) not in marks:
                            stay.append(line)
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.record_batch(
                [*part.columns[:n - 2], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*part.schema.names[:n - 2], "n_lines", "n_dropped", "kept"])


def salts_by_shard(lines: DataFrame, shard: Column) -> DataFrame:
    """A shard with more lines than a task should probe is copied for each of its salts; the others stay as they are."""
    return lines.groupBy(shard.alias("shard")).count().select("shard", F.ceil(F.col("count") / PROBE_ROWS).cast("int").alias("salts"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_rows: int = 2) -> DataFrame:
    """The other columns of ``docs`` with n_lines, n_dropped and kept (the remaining text).

    A line that at least two documents and ``least_rows`` rows hold stays in the first document alone.
    Lines are split at \\n; a null or empty text is one empty line. Rows with one
    id are one document. Lines of a document without an id count nowhere and all
    stay; so does a line of fewer than ten code points. Columns named like the
    results are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    results = "n_lines", "n_dropped", "kept"
    inner, back, (text, key) = carried(docs, results, text, key, gone=(text,))
    rest = [c for c, name in zip(inner.columns, docs.columns) if c != text and name.lower() not in results]
    source = inner.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    lines = stored(source.mapInArrow(_line_hashes, "doc long, h long, f long"), folder)
    keys = lines.groupBy("h", "f").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    keys = stored(keys.drop("last"), folder)
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    shard = F.pmod(F.col("h"), F.lit(shards))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_shard_row(int(group["shard"].iloc[0]), group.drop_duplicates("h"))])

    def twins(group: pd.DataFrame) -> pd.DataFrame:
        return group[group.duplicated("h")][["h", "f", "first", "n_docs"]]

    by_shard = keys.withColumn("shard", shard).groupBy("shard")
    arrays = stored(by_shard.applyInPandas(index, _INDEX), folder)
    # Two lines with one 64-bit hash: all but one of them are matched as plain rows.
    extra = stored(by_shard.applyInPandas(twins, "h long, f long, first long, n_docs long"), folder).where(F.col("n_docs") >= least_rows)

    loads = stored(salts_by_shard(lines, shard), folder)

    def probe(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"doc": [], "f": []}, dtype="int64")
        known, first = Shard(right.iloc[0].to_dict()).probe(left["h"].to_numpy(), left["f"].to_numpy(), least_rows)
        return left[["doc", "f"]][known & (first < left["doc"].to_numpy())]

    salted = arrays.join(F.broadcast(loads), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")  # a row per SHARD_KEYS keys
    probes = lines.withColumn("shard", shard).join(F.broadcast(loads), "shard").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).drop("salts")
    gone = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(probe, "doc long, f long")
    if not extra.isEmpty():
        gone = gone.unionAll(lines.join(extra, ["h", "f"]).where("first < doc").select("doc", "f"))
    gone = gone.groupBy("doc").agg(F.collect_list("f").alias("gone"))

    joined = inner.withColumn("doc", F.col(key).cast("long")).join(gone, "doc", "left").select(*rest, F.col(text).cast("string").alias("text"), "gone")
    kinds = "".join(f"{c} {inner.schema[c].dataType.simpleString()}, " for c in rest)
    return back(joined.mapInArrow(_without, f"{kinds}n_lines long, n_dropped long, kept string"))
