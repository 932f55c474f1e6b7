"""Document quality by a regularised quadratic discriminant.

Each class is a Gaussian over transformed statistics of whole texts. Its
covariance is shrunk towards the pooled one and then towards a multiple of the
identity; scores come from the difference of the log densities, worked out with
the classes' cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, byte_class, text_groups, word_hashes, words
from .tables import sample_rows, with_text

#: Labelled rows per class that the fit may use, about.
SAMPLE = 3000
TO_POOLED, TO_SPHERE = 0.5, 0.1
#: Log-density differences are divided by this: statistics that are not Gaussian make them too sure.
TEMPER = 4.0
WORD = byte_class((0x09, 0x0D), (0x20, 0x20))

_UPPER, _SMALL, _DIGIT, _STOP, _SHOUT, _BAR, _SIGN, _LINE, _HIGH = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _SMALL, _DIGIT, _HIGH
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = _STOP
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[10] = _SHOUT, _BAR, _LINE

STATISTICS = ("words", "word_length", "upper", "digits", "stops", "shouts", "bars", "signs", "lines", "repeats", "distinct")


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """Transformed statistics of whole texts, one row each: logarithms of sizes
    and of shares. A null or empty text has those of nothing."""
    for _, _, data, offs in text_groups(column):
        kind = _CLASS[data]

        def count(c: int) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kind == c, out=sums[1:])
            return np.diff(sums[offs])

        starts, ends, first = words(data, offs, WORD)
        hashes = word_hashes(LOWER[data], starts, ends)
        n = np.diff(first).astype(float)
        same = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > 1:
            np.cumsum(hashes[1:] == hashes[:-1], out=same[2:])
        repeats = np.where(first[1:] > first[:-1], same[first[1:]] - same[np.minimum(first[:-1] + 1, len(hashes))], 0)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], float)
        letters = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]).astype(float)
        upper, small = count(_UPPER), count(_SMALL)
        yield np.stack([
            np.log1p(n), np.log1p(letters / np.maximum(n, 1)), _share(upper, upper + small, 0.05, 40), _share(count(_DIGIT), letters, 0.005, 40), _share(count(_STOP), n, 0.2, 10),
            _share(count(_SHOUT), n, 0, 10), _share(count(_BAR), n, 0, 10), _share(count(_SIGN), n, 0, 10), _share(count(_LINE), n, 0.05, 20), _share(repeats, n, 0.01, 20),
            _share(distinct, n, 0.8, 20),
        ], 1)


def _share(x: np.ndarray, of: np.ndarray, usual: float, weight: float) -> np.ndarray:
    """The logarithm of a share, drawn to the usual one in short texts."""
    return np.log((x + usual * weight) / (of + weight) + 0.01)


@dataclass(frozen=True)
class Quadratic:
    """Two shrunken Gaussians; ``factors`` are inverse Cholesky factors."""

    center: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    bias: float
    odds: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, odds: float = 0.0) -> Quadratic | float:
        """A model, or the constant score where a class is missing (neither: 0.5)."""
        if not len(y) or y.min() == y.max():
            return float(y[0]) if len(y) else 0.5
        center, spread = x.mean(0), x.std(0)
        spread = np.where(spread > 1e-9, spread, 1.0)
        z = (x - center) / spread
        parts = [z[y == c] for c in (0, 1)]
        means = np.stack([p.mean(0) for p in parts])
        scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means)]
        pooled = sum(scatter) / len(z)
        factors, logs = [], []
        for p, s in zip(parts, scatter):
            c = (1 - TO_POOLED) * s / len(p) + TO_POOLED * pooled
            c = (1 - TO_SPHERE) * c + TO_SPHERE * np.trace(c) / len(c) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
            low = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(low))
            logs.append(np.log(np.diag(low)).sum())
        return Quadratic(center, spread, means, np.stack(factors), float(logs[0] - logs[1]), odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1, between 0 and 1."""
        z = (x - self.center) / self.spread
        d = [(((z - m) @ f.T) ** 2).sum(1) / 2 for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(np.clip((d[1] - d[0] - self.bias) / TEMPER - self.odds, -500, 500)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Quadratic | float:
    """A model from about ``sample`` labelled documents of each class.

    Labels other than 0 and 1 are left out; a document with both has 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    counts = dict(known.groupBy("_label").count().collect())
    chosen = F.broadcast(sample_rows(known, "_label", sample, key))  # at most 4 * sample rows
    rows = docs.select(key, F.col(text).cast("string").alias("_text")).join(chosen, key).select("_label", "_text")
    found = rows.mapInArrow(_statistic_rows, "label int, x array<double>").toArrow()
    if not found.num_rows:
        return 0.5
    x = found.column("x").combine_chunks()
    order = np.lexsort(np.asarray(x.values).reshape(len(x), -1).T)
    odds = np.log(counts[1] / counts[0]) if len(counts) == 2 else 0.0
    return Quadratic.fit(np.asarray(x.values).reshape(len(x), -1)[order], np.asarray(found.column("label"))[order], float(odds))


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([*statistics(batch.column(1)), np.empty((0, len(STATISTICS)))])
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))], ["label", "x"])


def score_quality(docs: DataFrame, model: Quadratic | float, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (higher: label 1 is likelier).

    Nulls and empty texts are scored as texts without words; a column named
    ``score`` is replaced.
    """
    source, rest, kinds, back = with_text(docs, text, ("score",), once=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([*statistics(batch.column(batch.num_columns - 1)), np.empty((0, len(STATISTICS)))])
            score = model.score(x) if isinstance(model, Quadratic) else np.full(len(x), model)
            yield pa.record_batch([*batch.columns[:len(rest)], pa.array(score)], [*rest, "score"])

    return back(source.mapInArrow(run, f"{kinds}score double"))
