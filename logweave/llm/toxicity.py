"""Severity grades of texts by cumulative-link ordinal regression.

The features of a text are its distinct words and the distinct runs of five
bytes in them (a blank stands before a word). One weight per feature is shared by
all grades; ordered thresholds cut the weighted sum, so that the chance of at
least grade g is a logistic function of the sum less threshold g.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U64, byte_class, mix, text_groups, word_hashes, words
from .tables import sample_rows, with_text

#: Labelled rows per grade that the fit may use (about); features in fewer of them have no weight.
SAMPLE, LEAST_TEXTS = 2000, 5
#: Features count if the square of their correlation with the grade, times the texts, is as large.
LEAST_CHI = 40.0
RUN = 5
PENALTY, ROUNDS, RATE = 1e-4, 300, 0.1
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct feature hashes of each text; A-Z are lower-cased, nulls are empty."""
    for _, _, data, offs in text_groups(column):
        data = np.insert(LOWER[data], offs[:-1], 32)
        offs = offs + np.append(np.arange(len(offs) - 1), len(offs) - 1)
        starts, ends, first = words(data, offs, WORD)
        hashes = word_hashes(data, starts, ends)
        inner = WORD[data]
        low = np.where(inner, data, 32).astype(np.uint64)
        n = max(0, len(data) - RUN + 1)
        runs, good = np.zeros(n, U64), np.ones(n, bool)
        for i in range(RUN):
            runs = runs << U64(8) | low[i:n + i]
            good &= inner[i:n + i] if i else True
        at = np.flatnonzero(good)
        runs = mix(runs[at] + U64(1 << 60))
        borders = np.searchsorted(at, offs)
        for d in range(len(offs) - 1):
            yield np.unique(np.concatenate([hashes[first[d]:first[d + 1]], runs[borders[d]:borders[d + 1]]]))


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _positions(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where the known ones of some sorted words stand in the vocabulary."""
    if not len(vocabulary):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return at[vocabulary[at] == words]


@dataclass(frozen=True)
class Ordinal:
    """Sorted feature hashes with their weights, and the ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def fit(sets: list[np.ndarray], grades: np.ndarray) -> Ordinal:
        """Weights by penalised likelihood, each grade with the same say.

        Grades are 0, 1, 2 …; without texts nothing is ever severe.
        """
        top = int(grades.max()) if len(grades) else 0
        if top == 0:
            return Ordinal(np.empty(0, U64), np.empty(0), np.full(1, 60.0))
        vocabulary, count = np.unique(np.concatenate(sets), return_counts=True)
        chi = np.zeros(len(vocabulary))
        at = np.concatenate([np.searchsorted(vocabulary, s) for s in sets])
        for g in range(1, top + 1):  # a feature may tell any two neighbouring grades apart
            centred = (grades >= g) - (grades >= g).mean()
            total = np.bincount(at, np.repeat(centred, [len(s) for s in sets]), len(vocabulary))
            chi = np.maximum(chi, total * total / np.maximum(count * (1 - count / len(sets)) * centred.var(), 1e-9))
        vocabulary = vocabulary[(count >= LEAST_TEXTS) & (chi >= LEAST_CHI)]
        found = [_positions(vocabulary, s) for s in sets]
        rows, cols = np.repeat(np.arange(len(sets)), [len(f) for f in found]), np.concatenate(found)
        n = np.bincount(grades, minlength=top + 1)
        say = (1 / np.maximum(n, 1))[grades] / (n > 0).sum()
        # The gaps between thresholds are exponentials, which keeps them in order.
        weights, cut, gaps = np.zeros(len(vocabulary)), np.zeros(1), np.zeros(top - 1)
        state = [np.zeros((2, x.size)) for x in (weights, cut, gaps)]
        for step in range(1, ROUNDS + 1):
            thresholds = cut[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            value = np.bincount(rows, weights[cols], len(sets))
            over = _chance(value[:, None] - thresholds)
            # Chance of the own grade: the difference of two neighbouring chances.
            full = np.concatenate([np.ones((len(sets), 1)), over, np.zeros((len(sets), 1))], 1)
            own = np.maximum(full[np.arange(len(sets)), grades] - full[np.arange(len(sets)), grades + 1], 1e-12)
            slope = over * (1 - over)
            sign = np.zeros_like(over)
            some = np.flatnonzero(grades > 0)
            sign[some, grades[some] - 1] += 1
            some = np.flatnonzero(grades < top)
            sign[some, grades[some]] -= 1
            part = say[:, None] * sign * slope / own[:, None]
            d_value = part.sum(1)
            d_cut = -part.sum(0)
            gradients = (
                np.bincount(cols, d_value[rows], len(vocabulary)) - PENALTY * weights, np.array([d_cut.sum()]),
                np.array([d_cut[g + 1:].sum() for g in range(top - 1)]) * np.exp(gaps) if top > 1 else np.zeros(0))
            for x, g, s in zip((weights, cut, gaps), gradients, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                x += RATE * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8)
            np.maximum(weights, 0, out=weights)  # no other word makes up for one that is severe
        return Ordinal(vocabulary, weights, cut[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))]))

    def over(self, sets: list[np.ndarray]) -> np.ndarray:
        """Chances of at least grade 1, 2, … of each text."""
        value = np.zeros(len(sets))
        if len(self.words):
            for i, s in enumerate(sets):
                value[i] = self.weights[_positions(self.words, s)].sum()
        return _chance(value[:, None] - self.thresholds)


def fit_severity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Ordinal:
    """A model from about ``sample`` labelled documents of each grade.

    Null and negative grades are left out; a document with several has the highest.
    """
    known = labels.where((F.col(label) >= 0) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = F.broadcast(sample_rows(known, "_label", sample, key))  # at most twice ``sample`` rows a grade

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in feature_sets(batch.column(1))]
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], ["label", "words"])

    found = docs.select(key, F.col(text).cast("string").alias("_text")).join(chosen, key).select("_label", "_text").mapInArrow(run, "label int, words array<long>").toArrow()
    rows = sorted(((g, np.asarray(w.values).view(np.uint64)) for g, w in zip(found.column("label").to_pylist(), found.column("words"))), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return Ordinal.fit([r[1] for r in rows], np.array([r[0] for r in rows], np.int64))


def score_severity(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``severity`` (expected grade) and ``grade`` (the likeliest).

    Nulls and empty texts have no words; columns named like the results are replaced.
    """
    source, rest, kinds, back = with_text(docs, text, ("severity", "grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = model.over(list(feature_sets(batch.column(len(rest)))))
            each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], 1), axis=1)
            yield pa.record_batch([*batch.columns[:len(rest)], pa.array(over.sum(1)), pa.array(each.argmax(1).astype(np.int32))], [*rest, "severity", "grade"])

    return back(source.mapInArrow(run, f"{kinds}severity double, grade int"))
