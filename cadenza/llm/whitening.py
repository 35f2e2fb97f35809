"""Whitening of embeddings with a cyclic Jacobi eigensolver.

Entries become whole numbers, floor(SCALE * c). The fit list holds each distinct vector once, so that a vector a third
of the rows repeat weighs as one; equal vectors combine before the shuffle. Per-dimension sums are exact (two limbs a
partition, added as decimals); every partition then adds up the scatter of its centred vectors, some partitions' sums
are added in a task each, and the driver adds those and applies symmetric Jacobi rotations, pair by pair and sweep by
sweep, until no off-diagonal entry matters beside its diagonal ones: small eigenvalues come out as accurately as large
ones. The driver holds matrices of dimension squared, nothing that grows with the rows; the projection, some
components wide, goes to the tasks with their code.

Defined cases: a row whose vector is null or holds a null, NaN or infinite entry is dropped; a shorter vector is filled
with zeros to the longest one's length (an empty one is all zeros); entries stop at 2**53 either way; repeated rows and
null ids are rows as any other; a component without variance (eigenvalue not over dimensions * 2**-52 of the largest)
has whitened null and takes no part in identity_error; a deviation beyond a long is null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import merged_sums, stage

SCALE = 256
COMPONENTS = 4
_MOST = float(1 << 53)
_LIMB = 26


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole-number vector, of the rows whose vector is there and finite."""
    value = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = embeddings.select("vec_id", value.alias("_v")).where(F.col("_v").isNotNull() & F.forall("_v", finite))
    whole = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_MOST)), F.lit(-_MOST)))
    return good.select("vec_id", F.transform("_v", whole).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x of `rows` once, staged; where lengths differ, those that are equal when filled with zeros are one."""
    fit = stage(rows.select("x").distinct())
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return fit
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))
    return stage(fit.select(F.concat("x", fill).alias("x")).distinct())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to `width`."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if width and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Moments:
    """Count, exact per-dimension sums and covariance of a fit list."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The rows of `fit` (x) and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), max(np.diff(batch.column(0).offsets.to_numpy()), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array((x >> _LIMB).sum(axis=0)), pa.array((x & (1 << _LIMB) - 1).sum(axis=0))], ["dimension", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = fit.select("x").mapInArrow(partial, "dimension int, high long, low long").groupBy("dimension").agg(exact("high"), exact("low")).orderBy("dimension").collect()
    return fit.count(), [(int(r["high"]) << _LIMB) + int(r["low"]) for r in got]


def moments(fit: DataFrame) -> Moments:
    """Moments of the distinct vectors `fit` (x, staged): a pass for the mean, one for the centred scatter."""
    n, total = sums(fit)
    width = len(total)
    mean = np.array([s / n for s in total])

    def scatter(x: pa.RecordBatch) -> np.ndarray:
        d = _matrix(x.column(0), width) - mean
        return d.T @ d

    return Moments(n, tuple(total), merged_sums(fit.select("x"), scatter, (width, width)) / max(n, 1))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Each rotation makes one off-diagonal entry zero; a sweep visits all pairs in order. It ends when every entry is
    under 2**-53 of the geometric mean of its diagonal ones (or of nothing but zeros), which keeps small eigenvalues
    accurate. Convergence is quadratic, some ten sweeps.
    """
    a = (matrix + matrix.T) / 2
    size = len(a)
    v = np.eye(size)
    for _ in range(sweeps):
        turned = False
        for p in range(size - 1):
            for q in range(p + 1, size):
                off = a[p, q]
                if off == 0 or abs(off) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                with np.errstate(over="ignore"):
                    tau = (a[q, q] - a[p, p]) / (2 * off)
                    t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                low, high = a[p].copy(), a[q].copy()
                a[p], a[q] = c * low - s * high, s * low + c * high
                low, high = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * low - s * high, s * low + c * high
                a[p, q] = a[q, p] = 0.0
                low, high = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * low - s * high, s * low + c * high
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """Mean and projection (dimensions x components, columns over the root of their eigenvalue; 0 for a component without variance)."""

    mean: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    there: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection


def whitening(m: Moments, components: int = COMPONENTS) -> Whitening:
    values, vectors = jacobi(m.covariance)
    k = min(components, len(values))
    there = values[:k] > len(values) * 2.0**-52 * (values[0] if len(values) else 0)
    roots = np.sqrt(np.where(there, values[:k], 1))
    trace = float(np.trace(m.covariance))
    return Whitening(m.mean, np.where(there, vectors[:, :k] / roots, 0), np.where(there, values[:k], 0) / (trace or 1), there)


def identity_error(fit: DataFrame, m: Moments, w: Whitening) -> float:
    """The largest absolute entry of the covariance of `fit`, whitened, minus the identity; over the components that have variance."""
    width, k = len(m.sums), w.projection.shape[1]
    some = np.flatnonzero(w.there)
    if not len(some):
        return 0.0
    of = lambda batch: w.apply(_matrix(batch.column(0), width))
    mean = merged_sums(fit.select("x"), lambda b: of(b).sum(axis=0), (k,)) / m.n

    def scatter(batch: pa.RecordBatch) -> np.ndarray:
        d = of(batch) - mean
        return d.T @ d

    covariance = merged_sums(fit.select("x"), scatter, (k, k)) / m.n
    return float(np.abs(covariance[np.ix_(some, some)] - np.eye(len(some))).max())


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> pa.Array:
    """The sum over dimensions of (n * x - total) ** 2 of each row, exact; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if len(total) * most**2 < 1 << 63:
        d = n * x - np.array(total, np.int64)
        return pa.array((d * d).sum(axis=1))
    d = n * x.astype(object) - np.array(total, object)
    return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(axis=1)], pa.int64())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and component."""
    rows = whole_vectors(embeddings)
    fit = fit_list(rows)
    m = moments(fit)
    w = whitening(m, components)
    error, width = identity_error(fit, m, w), len(m.sums)
    k = w.projection.shape[1]
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            whitened = pa.array(w.apply(x).ravel(), mask=np.tile(~w.there, len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), m.n)), deviations(x, m.n, m.sums).take(row), whitened, pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(row), error))],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
