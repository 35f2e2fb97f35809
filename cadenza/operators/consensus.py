"""Homographies between pairs of images from point matches of which some are wrong: by sampling and consensus.

A bounded sample of each pair's matches, chosen by a hash, gives hypotheses: seeded sets of four, solved together. The
few that most of the sample agrees with are then counted over all matches, in a join and a sum that combines before the
shuffle, and the winner is fitted again to all its inliers, by sums alone. So a pair may have any number of matches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 512
SETS = 400
KEPT = 4
SEED = 17

# The rules by which a link is rejected.
LEAST_MATCHES, LEAST_INLIERS = 18, 16
SPREAD_X, SPREAD_Y = 0.35, 0.20
LEAST_CONFIDENCE, LEAST_DETERMINANT = 0.70, 0.1
THRESHOLD = 1.0

#: Twice the area, in shares of an image, under which three of a set's points count as in a line.
LEAST_AREA = 1e-9


def solved(points: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The homographies (n, 3, 3) that map sets of four points (n, 4, 2) to their targets: null vectors of the direct linear equations."""
    n = len(points)
    x, y, u, v = points[..., 0], points[..., 1], targets[..., 0], targets[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    a = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=-1)], axis=2)
    return np.linalg.svd(a.reshape(n, 8, 9))[2][:, -1].reshape(n, 3, 3)


def _frame(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of four points (n, 4, 2): adjugates of the matrices of the first three, the fourth in their terms, and each set's least doubled area."""
    x, y = p[..., 0], p[..., 1]
    i, j = [1, 2, 0], [2, 0, 1]
    adjugates = np.stack([y[:, i] - y[:, j], x[:, j] - x[:, i], x[:, i] * y[:, j] - x[:, j] * y[:, i]], axis=2)
    fourth = adjugates[..., 0] * x[:, 3:] + adjugates[..., 1] * y[:, 3:] + adjugates[..., 2]
    whole = adjugates[..., 2].sum(axis=1)
    return adjugates, fourth, np.minimum(np.abs(fourth).min(axis=1), np.abs(whole))


def framed(points: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The homographies that `solved` finds, up to a factor, in closed form, and which of them four such points fix: where three are in a line they do not."""
    adjugates, a, least = _frame(points)
    _, b, there = _frame(targets)
    weights = np.stack([b[:, 0] * a[:, 1] * a[:, 2], a[:, 0] * b[:, 1] * a[:, 2], a[:, 0] * a[:, 1] * b[:, 2]], axis=1)
    corners = np.concatenate([targets[:, :3].transpose(0, 2, 1), np.ones((len(targets), 1, 3))], axis=1)
    return (corners * weights[:, None]) @ adjugates, np.minimum(least, there) >= LEAST_AREA


@lru_cache(maxsize=64)
def _picks(n: int, sets: int) -> np.ndarray:
    """The sets of four of n matches; the seed is fixed, so they depend on nothing else."""
    return np.random.default_rng(SEED).random((sets, n)).argpartition(3, axis=1)[:, :4]


def agreeing(matrices: np.ndarray, rows: np.ndarray, w: float, h: float) -> np.ndarray:
    """How many matches (m, 4), in shares of w and h, each of the matrices (n, 3, 3) maps to within THRESHOLD pixels."""
    n = len(matrices)
    p = (matrices.reshape(-1, 3) @ np.stack([rows[:, 0], rows[:, 1], np.ones(len(rows))])).reshape(n, 3, len(rows))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x, y = (p[:, 0] / p[:, 2] - rows[:, 2]) * w, (p[:, 1] / p[:, 2] - rows[:, 3]) * h
        return np.count_nonzero(x * x + y * y <= THRESHOLD * THRESHOLD, axis=1)


def mapped(matrices: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Where matrices (n, 3, 3) map points (m, 2): (n, m, 2)."""
    p = np.einsum("nij,mj->nmi", matrices, np.hstack([points, np.ones((len(points), 1))]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return p[..., :2] / p[..., 2:]


def hypotheses(matches: DataFrame, sizes: DataFrame, sets: int, kept: int) -> DataFrame:
    """pair, hypothesis, m (nine numbers, between coordinates in shares of width - 1 and height - 1), at most `kept` a pair."""
    counts = matches.groupBy(F.col("pair").alias("_pair")).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64("pair", "x", "y", "u", "v"), F.lit(1 << 30)) / float(1 << 30)
    some = matches.join(counts, F.col("pair") == F.col("_pair")).where(share * F.col("_n") < SAMPLE)
    some = some.join(sizes.select(F.col("pair").alias("_p"), "width", "height"), F.col("pair") == F.col("_p"))

    def of(table: pa.Table) -> pa.Table:
        w, h = table.column("width")[0].as_py() - 1, table.column("height")[0].as_py() - 1
        rows = np.stack([table.column(c).to_numpy() for c in ("x", "y", "u", "v")], axis=1) / [w, h, w, h]
        rows = rows[np.lexsort(rows.T)]  # the order of a shuffle must not matter
        if len(rows) < 4:
            return table.slice(0, 0).select(["pair"]).append_column("hypothesis", pa.array([], pa.int32())).append_column("m", pa.array([], pa.list_(pa.float64())))
        picks = _picks(len(rows), sets)
        points, targets = rows[picks, :2], rows[picks, 2:]
        matrices, fixed = framed(points, targets)
        agree = np.where(fixed, agreeing(matrices, rows, w, h), 0)
        if 2 * agree.max() < len(rows):  # else no map of a set in a line, which leaves the rest of the plane open, is needed
            matrices[~fixed] = solved(points[~fixed], targets[~fixed])
            agree[~fixed] = agreeing(matrices[~fixed], rows, w, h)
        best = np.argsort(-agree, kind="stable")[:kept]
        pair = pa.array([table.column("pair")[0].as_py()] * len(best), table.schema.field("pair").type)
        return pa.table({"pair": pair, "hypothesis": pa.array(np.arange(len(best), dtype=np.int32)), "m": pa.array(matrices[best].reshape(-1, 9).tolist(), pa.list_(pa.float64()))})

    kind = matches.schema["pair"].dataType.simpleString()
    return some.select("pair", "width", "height", "x", "y", "u", "v").groupBy("pair").applyInArrow(of, f"pair {kind}, hypothesis int, m array<double>")


def _off(m: Column, x: Column, y: Column, u: Column, v: Column, w: Column, h: Column) -> Column:
    """How many pixels the map is off the match."""
    z = m[6] * x + m[7] * y + m[8]
    return F.hypot(((m[0] * x + m[1] * y + m[2]) / z - u) * w, ((m[3] * x + m[4] * y + m[5]) / z - v) * h)


def _refitted(sums: DataFrame, names: list[str]) -> DataFrame:
    """`sums` with m, fitted by least squares to what the sums are of."""
    at = [names.index(f"s{i}") for i in range(24)]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            s = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1).reshape(n, 4, 6)
            # Moments of (x, y, 1), by nothing, u, v and u * u + v * v.
            p, pu, pv, pq = (s[:, i][:, [[3, 4, 1], [4, 5, 2], [1, 2, 0]]] for i in range(4))
            zero = np.zeros_like(p)
            a = np.concatenate([np.concatenate([p, zero, -pu], axis=2), np.concatenate([zero, p, -pv], axis=2), np.concatenate([-pu, -pv, pq], axis=2)], axis=1)
            m = np.linalg.eigh(a)[1][:, :, 0] if n else np.zeros((0, 9))
            with np.errstate(divide="ignore", invalid="ignore"):
                m = m / m[:, 8:]
            yield batch.append_column("m", pa.array(m.tolist(), pa.list_(pa.float64())))

    return sums.mapInArrow(run, sums.withColumn("m", F.lit(None).cast("array<double>")).schema)


def homographies(matches: DataFrame, sizes: DataFrame, least_confidence: float = LEAST_CONFIDENCE, sets: int = SETS, kept: int = KEPT) -> DataFrame:
    """pair, matches, inliers, confidence, m and reason (null: accepted) of every row of `sizes` (pair, width, height, described).

    matches: pair, x, y, u, v in pixels; rows that repeat count each. m is between coordinates in shares of width - 1
    and height - 1, its last number 1; it, inliers and confidence are null for a rejected pair. Reasons, the first that
    holds: no-features (not described), few-matches, few-inliers, narrow-coverage (inliers span too little of the image),
    low-confidence (too small a share agrees, or a matrix that is not finite or nearly flat).
    """
    points = matches.groupBy("pair", "x", "y", "u", "v").agg(F.count("*").alias("w"))
    n = points.groupBy(F.col("pair").alias("_pair")).agg(F.sum("w").alias("matches"))
    guesses = hypotheses(points, sizes, sets, kept).withColumnRenamed("pair", "_g")
    scaled = points.join(sizes.select(F.col("pair").alias("_s"), (F.col("width") - 1).alias("_w"), (F.col("height") - 1).alias("_h")), F.col("pair") == F.col("_s"))
    scaled = scaled.select("pair", "w", "_w", "_h", *((F.col(c) / F.col(s)).alias(c) for c, s in (("x", "_w"), ("y", "_h"), ("u", "_w"), ("v", "_h"))))
    c = F.col
    tried = scaled.join(guesses, c("pair") == c("_g")).where(_off(c("m"), c("x"), c("y"), c("u"), c("v"), c("_w"), c("_h")) <= THRESHOLD)
    moments = [F.lit(1.0), c("x"), c("y"), c("x") * c("x"), c("x") * c("y"), c("y") * c("y")]
    by = [F.lit(1.0), c("u"), c("v"), c("u") * c("u") + c("v") * c("v")]
    sums = [F.sum(c("w") * a * b).alias(f"s{6 * i + j}") for i, a in enumerate(by) for j, b in enumerate(moments)]
    spread = [(F.max(a) - F.min(a)).alias(f"spread_{a}") for a in ("x", "y")]
    scores = tried.groupBy("pair", "hypothesis").agg(F.sum("w").alias("inliers"), *spread, *sums)
    every = [x for x in scores.columns if x not in ("pair", "hypothesis")]
    best = scores.groupBy("pair").agg(F.max_by(F.struct(*every), F.struct("inliers", -c("hypothesis"))).alias("b")).select("pair", "b.*")
    best = _refitted(best, best.columns).select(c("pair").alias("_best"), "inliers", "spread_x", "spread_y", "m")
    all_ = sizes.join(n, c("pair") == c("_pair"), "left").join(best, c("pair") == c("_best"), "left")
    m = c("m")
    flat = F.abs(m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])) < LEAST_DETERMINANT
    found = F.coalesce(c("inliers"), F.lit(0))
    finite = F.forall("m", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    reason = (
        F.when(~c("described"), "no-features")
        .when(F.coalesce(c("matches"), F.lit(0)) < LEAST_MATCHES, "few-matches")
        .when(found < LEAST_INLIERS, "few-inliers")
        .when((c("spread_x") * (c("width") - 1) < c("width") * SPREAD_X) | (c("spread_y") * (c("height") - 1) < c("height") * SPREAD_Y), "narrow-coverage")
        .when((found / c("matches") < least_confidence) | ~finite | flat, "low-confidence")
    )
    out = all_.withColumn("reason", reason)
    good = c("reason").isNull()
    return out.select("pair", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.when(good, c("inliers")).alias("inliers"), F.when(good, c("inliers") / c("matches")).alias("confidence"), F.when(good, c("m")).alias("m"), "reason")
