"""Language of a text by a string kernel.

The blended-spectrum presence kernel of two texts counts the letter n-grams of
one to three letters that both have, over the root of the product of their
numbers. Landmark texts give Nyström features, on which kernel ridge regression
is fitted for each language against the rest. A batch is scored by one matrix
product of its n-gram presence with the folded weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import text_slices
from .tables import sample_rows, with_text

#: Labelled rows per language that the fit may use (about), and how many of them are landmarks.
SAMPLE, LANDMARKS = 300, 32
MOST_LANDMARKS = 1024
RIDGE = 1e-2
_BLOCK_CELLS = 4 << 20
UNKNOWN = "und"

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def grams(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text as numbers; empty without letters.

    Letters are lower-cased; what lies between them counts as one blank.
    """
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.where(letter, a, 32)[keep].astype(np.uint64)
    a = np.concatenate([[32], a, [32]]).astype(np.uint64)
    two = a[:-1] << np.uint64(21) | a[1:]
    return np.unique(np.concatenate([a, two, two[:-1] << np.uint64(21) | a[2:]]))


@dataclass(frozen=True)
class Kernel:
    """Sorted n-grams of the landmarks, their weight for each language, the languages."""

    grams: np.ndarray
    weights: np.ndarray
    languages: tuple[str, ...]

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row per text: which n-grams it has, scaled by the root of their number."""
        out = np.zeros((len(sets), len(self.grams)), np.float32)
        for row, own in zip(out, sets):
            if len(own):
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                row[at[self.grams[at] == own]] = 1 / np.sqrt(len(own))
        return out

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> Kernel:
        sets = [grams(t) for t in texts]
        known = [i for i, s in enumerate(sets) if len(s)]
        sets, labels = [sets[i] for i in known], [labels[i] for i in known]
        languages = tuple(sorted(set(labels)))
        if not languages:
            return Kernel(np.empty(0, np.uint64), np.empty((0, 0), np.float32), ())
        each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
        marks = [i for lang in languages for i in [j for j, own in enumerate(labels) if own == lang][:each]]
        all_grams = np.unique(np.concatenate([sets[i] for i in marks]))
        empty = Kernel(all_grams, np.empty((0, 0)), languages)
        own = np.concatenate([empty.presence([sets[i]]) for i in marks]).astype(np.float64)
        between = own @ own.T
        values, vectors = np.linalg.eigh(between)
        good = values > 1e-8 * values[-1]
        to_features = vectors[:, good] / np.sqrt(values[good])
        step = max(1, _BLOCK_CELLS // max(1, len(all_grams)))
        features = np.concatenate([empty.presence(sets[at:at + step]).astype(np.float64) @ own.T for at in range(0, len(sets), step)]) @ to_features
        is_lang = np.array([[x == lang for lang in languages] for x in labels], float)
        weight = (is_lang / is_lang.sum(0)).sum(1)[:, None] * len(labels) / len(languages)
        inner = features.T @ (weight * features) + RIDGE * len(labels) * np.eye(features.shape[1]) / len(languages)
        solved = np.linalg.solve(inner, features.T @ (weight * is_lang))
        return Kernel(all_grams, (own.T @ (to_features @ solved)).astype(np.float32), languages)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        step = max(1, _BLOCK_CELLS // max(1, len(self.grams)))
        for at in range(0, len(texts), step):
            sets = [grams(t) if t else np.empty(0, np.uint64) for t in texts[at:at + step]]
            if not self.languages:
                names += [UNKNOWN] * len(sets)
                scores += [0.0] * len(sets)
                continue
            chance = np.maximum(self.presence(sets) @ self.weights, 0).astype(np.float64)
            best = chance.argmax(1)
            top = chance[np.arange(len(sets)), best]
            total = chance.sum(1)
            share = np.where(total > 0, top / np.where(total > 0, total, 1), 1 / len(self.languages))
            for s, b, p in zip(sets, best.tolist(), share.tolist()):
                names.append(self.languages[b] if len(s) else UNKNOWN)
                scores.append(min(1.0, p) if len(s) else 0.0)
        return names, scores


def fit_languages(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Kernel:
    """A kernel machine from about ``sample`` texts of each label.

    Rows without label or text are left out; the order of rows plays no part.
    More than ``tables.MOST_LABELS`` labels are an error.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(text).cast("string").alias("_text"))
    found = sample_rows(known, "_label", sample, "_key").select("_label", "_text", F.xxhash64("_key", F.lit(3)).alias("_at")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["_at"], r["_text"]))
    return Kernel.fit([r["_text"] for r in found], [r["_label"] for r in found])


def predict_languages(docs: DataFrame, model: Kernel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    A null text or one without a letter is ``und`` with score 0, as is every text
    under a model without languages; of equal scores the first name wins. Columns
    named like the results are replaced.
    """
    source, rest, kinds, back = with_text(docs, text, ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch, len(rest)):
                part = batch.slice(first, last - first)
                names, scores = model.predict(part.column(len(rest)).to_pylist())
                yield pa.record_batch([*part.columns[:len(rest)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return back(source.mapInArrow(run, f"{kinds}lang_pred string, score double"))
