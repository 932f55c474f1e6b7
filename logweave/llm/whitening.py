"""Whitening of embeddings: leading components of their covariance by contour integration.

Sums and the covariance are gathered in two scans. The covariance is as large as
the vectors are wide, not as there are many, and is solved on the driver: inertia
counts place the edges of intervals between eigenvalues, a quadrature of
resolvents along a circle round each interval projects onto its eigenspace,
Rayleigh-Ritz extracts the components, and an interval is only done when it
has as many as its inertia says. A third scan projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import carried, stored

#: The widest vectors taken: the driver holds a few square matrices of that size.
WIDEST = 2048
#: Entries become long numbers: floor(SCALE * entry) + SHIFT, within +-LARGEST.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 40
COMPONENTS = 8
NODES, ROUNDS, TRIES = 8, 40, 6
#: Eigenvalues whose ratio is beyond this are never in one interval.
SPAN = 4.0
_LIMB = 24
_RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix similar to ``a`` (Householder)."""
    a = np.array(a, float)
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        part = a[k + 1:, k + 1:]
        p = 2 * (part @ v)
        w = p - (v @ p) * v
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, v[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues lie above each shift, by the signs of the
    pivots of the shifted tridiagonal matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    above = (pivot > 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        above += pivot > 0
    return above


def eigenvalue_bounds(diagonal: np.ndarray, off: np.ndarray, k: int, steps: int = 60) -> np.ndarray:
    """The ``k`` largest eigenvalues to about machine precision of the largest, by bisection on inertia."""
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    lo, hi = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    rank = np.arange(k)
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = count_above(diagonal, off, mid) > rank
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _gaps(values: np.ndarray, k: int) -> np.ndarray:
    """Gaps behind the k-th of the descending ``values`` and those after it; 0 where bisection sees none."""
    gaps = values[k - 1:-1] - values[k:]
    return np.where(gaps > 1e-9 * abs(values[0]), gaps, 0)


def intervals(values: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Runs of the descending ``values`` that together hold the first ``k`` or more: a run ends at
    a ratio over ``SPAN``, the last one at the widest gap among those behind the k-th value, or with all values."""
    gaps = _gaps(values, k)
    last = k + int(np.argmax(gaps)) if gaps.any() else len(values)
    cuts = [0, *(i for i in range(1, last) if values[i - 1] > SPAN * max(values[i], 0)), last]
    return list(zip(cuts, cuts[1:]))


def feast(a: np.ndarray, lo: float, hi: float, inside: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of ``a`` between ``lo`` and ``hi``, of which inertia says there are ``inside``."""
    d = len(a)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    center, radius = (lo + hi) / 2, (hi - lo) / 2
    norm = np.abs(a).sum(1).max()
    for attempt in range(TRIES):
        size = min(d, max(inside + 4, -(-3 * inside // 2)) << attempt)
        y = np.random.default_rng(seed + attempt).standard_normal((d, size))
        before = np.inf
        for _ in range(ROUNDS):
            q = np.zeros_like(y)
            for weight, angle in zip(weights, angles):  # the lower half of the circle is the conjugate of the upper
                z = center + radius * np.exp(1j * angle)
                q += weight / 2 * radius * np.real(np.exp(1j * angle) * np.linalg.solve(z * np.eye(d) - a, y))
            q, _ = np.linalg.qr(q)
            values, small = np.linalg.eigh(q.T @ a @ q)
            y = q @ small
            left = np.linalg.norm(a @ y - y * values, axis=0)
            found = (values > lo) & (values <= hi) & (left <= 1e-9 * norm)
            worst = left[found].max(initial=0.0)
            if found.sum() == inside and worst >= before / 2:  # as small as it gets
                return values[found][::-1], y[:, found][:, ::-1]
            before = worst if found.sum() == inside else np.inf
    raise ArithmeticError(f"{inside} eigenvalues between {lo} and {hi} were not all found")


def components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``k`` eigenvalues of a covariance and their unit eigenvectors, as columns.

    Fewer where the rank is lower. The largest entry of a vector is positive.
    """
    d = len(cov)
    scale = float(np.trace(cov))
    if d == 0 or scale <= 0:
        return np.empty(0), np.empty((d, 0))
    a = cov / scale
    diagonal, off = tridiagonal(a)
    take = min(d, max(2 * k, k + 8))
    values = eigenvalue_bounds(diagonal, off, take)
    while take < d and not _gaps(values, k).any():
        take = min(d, 2 * take)
        values = eigenvalue_bounds(diagonal, off, take)
    rank = int((values > 4 * d * np.finfo(float).eps * values[0]).sum())
    k = min(k, rank)
    parts = []
    for first, last in intervals(values, k):
        hi = 2 * values[0] if first == 0 else (values[first - 1] + values[first]) / 2
        lo = (values[last - 1] + values[last]) / 2 if last < len(values) else values[-1] - (hi - values[-1]) / 16
        above = count_above(diagonal, off, np.array([lo, hi]))
        parts.append(feast(a, lo, hi, int(above[0] - above[1])))
    # Rayleigh-Ritz once more over all intervals: their vectors are then orthogonal to the last digit.
    q, _ = np.linalg.qr(np.concatenate([v for _, v in parts], 1))
    values, small = np.linalg.eigh(q.T @ a @ q)
    values, vectors = values[::-1][:k] * scale, (q @ small)[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values, vectors * signs


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """The other columns of ``rows``, once for each component from 1 on, with component, n,
    deviation, whitened, explained and identity_error.

    Entries c, as double, become x = floor(1024 c) + 100000. n rows are left without
    those whose vector is null or holds nulls or non-finite entries; repeated rows
    all count. Vectors of another length than the most frequent one (of equally
    frequent ones the longest) are left out too, as are empty ones. With S the sums of
    x, deviation is the exact sum of (n x - S)^2, null where a long cannot hold it;
    whitened is x - S / n projected on the component, over the root of its
    eigenvalue; explained is the eigenvalue's share of the trace; identity_error is
    the largest entry of the covariance of whitened less the identity. There are as
    many components as the rank, at most ``k``: none where all vectors are equal,
    and then, as for an empty table, no rows. Entries beyond 2^40 in size
    count as 2^40. Vectors wider than ``WIDEST`` are an error. Columns named like
    the results are replaced.
    """
    inner, back, (vector,) = carried(rows, _RESULTS, vector, gone=(vector,))
    inner = inner.withColumn("vector", F.col(vector).cast("array<double>")).drop(vector)
    wrong = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = inner.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~wrong)
    sizes = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    columns = [c for c in inner.columns if c != "vector"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema if f.name != "vector") + ", " * bool(columns)
    out = f"{kinds}n long, deviation long, whitened array<double>"
    if not sizes:
        return _results(back, good.select(*columns, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), np.empty(0), 1.0, 0.0)
    d = sizes[0]["d"]
    if d > WIDEST:
        raise ValueError(f"vectors of {d} entries; at most {WIDEST} are taken")
    good = good.where(F.size("vector") == d)
    vectors = good.select("vector")

    n, sums = _total(vectors.mapInArrow(_sums(d), "n long, sums array<decimal(38,0)>"), d)
    mean = np.array([s / n for s in sums])
    cov = _covariance(vectors, mean, d) / n
    values, axes = components(cov, k)
    scores = stored(good.select(*columns, "vector").mapInArrow(_project(n, sums, mean, axes / np.sqrt(values)), out))
    return _results(back, scores, values, float(np.trace(cov)), _identity_error(scores, len(values)))


def _results(back, scores: DataFrame, values: np.ndarray, trace: float, error: float) -> DataFrame:
    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array().cast("array<double>")
    each = scores.select(*[c for c in scores.columns if c != "whitened"], F.posexplode("whitened").alias("place", "whitened"))
    return back(each.withColumns({
        "component": (F.col("place") + 1).cast("int"), "explained": F.element_at(shares, F.col("place") + 1) if len(values) else F.lit(0.0), "identity_error": F.lit(error)}))


def _longs(column: pa.Array, d: int) -> np.ndarray:
    flat = np.asarray(column.flatten()).reshape(-1, d)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _longs(batch.column(0), d)
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist())]
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])

    return run


def _total(parts: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and sums of all tasks; the sums are added up by position, on the executors."""
    parts = stored(parts)
    n = parts.agg(F.sum("n")).first()[0]
    by = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    return n, [int(r["s"]) for r in sorted(by, key=lambda r: r["i"])]


def _covariance(vectors: DataFrame, mean: np.ndarray, d: int) -> np.ndarray:
    """The sum of the outer products of centred rows: each task has a matrix, and each
    row of it is added up over the tasks in the order of their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, some = np.zeros((d, d)), False
        for batch in batches:
            x = _longs(batch.column(0), d) - mean
            m += x.T @ x
            some = True
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * d), pa.array(range(d), pa.int32()), pa.array(list(m))], ["task", "i", "m"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("task")))
        m = np.asarray(table.column("m").combine_chunks().flatten()).reshape(-1, d)
        return pa.table({"i": table.column("i")[:1], "m": pa.array([m[order].sum(0)])})

    rows = vectors.mapInArrow(run, "task long, i int, m array<double>").groupBy("i").applyInArrow(add, "i int, m array<double>").collect()
    return np.array([r["m"] for r in sorted(rows, key=lambda r: r["i"])])


def _project(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray):
    low, k = (1 << _LIMB) - 1, axes.shape[1]
    # Every n x - S fits an int64, or whole numbers of Python are used.
    fits = n * (LARGEST + SHIFT) * 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, np.int64 if fits else object)
        for batch in batches:
            x = _longs(batch.column(batch.num_columns - 1), len(sums))
            away = np.abs(n * (x if fits else x.astype(object)) - total)
            if len(x) and away.max() < 1 << 50:
                away = away.astype(np.int64)
                a, b = away >> _LIMB, away & low
                parts = [(p * q).sum(1).tolist() for p, q in ((a, a), (a, b), (b, b))]
                deviation = [(p << 2 * _LIMB) + (q << _LIMB + 1) + r for p, q, r in zip(*parts)]
            else:
                deviation = [sum(v * v for v in row) for row in away.tolist()]
            whitened = (x - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(whitened.ravel()))
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(np.full(len(x), n)), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), lists],
                [*batch.schema.names[:-1], "n", "deviation", "whitened"])

    return run


def _identity_error(scores: DataFrame, k: int) -> float:
    """Spark's covariances merge centred sums, so they too are centred before multiplying."""
    if not k:
        return 0.0
    cells = [(i, j) for i in range(k) for j in range(i + 1)]
    found = scores.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in cells]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, cells))
