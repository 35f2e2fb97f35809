"""Aggregates of runs: partial results by chunk, and what they come to by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk: counts, shares, the mean refresh delta (0 without any) and the population deviation of scale."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.count_if("refresh").alias("refreshed"),
        F.count_if("cut").alias("cuts"),
        (F.count_if(F.col("confidence") < 0.1) / F.greatest(F.lit(1), F.count("confidence"))).alias("low_confidence"),
        F.coalesce(F.avg(F.when(F.col("refresh"), F.col("delta"))), F.lit(0.0)).alias("mean_delta"),
        F.coalesce(F.stddev_pop("scale"), F.lit(0.0)).alias("scale_deviation"),
    )


def run_results(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per run, from its chunks alone: sums, and shares weighted by frames."""
    frames = F.sum("frames")
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), frames.alias("frames"), F.sum("cuts").alias("cuts"), (F.sum(F.col("low_confidence") * F.col("frames")) / frames).alias("low_confidence"), F.max("scale_deviation").alias("largest_deviation"))


#: So many rows make a range of values of their own, and there are at most so many ranges.
RANGE_ROWS, MOST_RANGES = 1 << 17, 1 << 14


def ranges_of(rows: DataFrame, value: str) -> tuple[Column, int]:
    """A column that numbers ranges of `value` in order, each with about as many rows, and how many ranges there are.

    Splitters come from a mergeable quantile sketch over all rows, whatever the distribution; equal values are in one
    range. A row finds its range in two steps, among every so many splitters and then among those between.
    """
    v = F.col(value).cast("double")
    some = rows.where(F.col(value).isNotNull())
    wanted = min(MOST_RANGES, some.count() // RANGE_ROWS + 1)
    if wanted == 1:
        return F.lit(0).cast("long"), 1
    sketch = some.agg(F.percentile_approx(v, [i / wanted for i in range(1, wanted)], max(10_000, 4 * wanted)).alias("q")).first()["q"]
    splitters = sorted(set(sketch))
    step = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    array = lambda x: F.array(*map(F.lit, x))
    below = lambda x: F.size(F.filter(x, lambda s: s < v))
    group = F.greatest(below(array([g[0] for g in groups])) - 1, F.lit(0))
    return (group * step + below(F.get(F.array(*map(array, groups)), group))).cast("long"), len(splitters) + 1


def ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each distinct value of a key (nulls left out) with _upto, how many are at most so large, and _all, how many there are.

    Equal values are counted before the shuffle. A key may hold most of the rows, so where there are many no window
    spans one: running totals come from the totals of ranges of values, then inside each range.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    in_range, n = ranges_of(rows, value)
    all_ = Window.partitionBy(*keys)
    if n == 1:
        upto = F.sum("_n").over(all_.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.select(*keys, value, "_n", upto.alias("_upto"), F.sum("_n").over(all_).alias("_all"))
    counts = counts.withColumn("_range", in_range)
    before = all_.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"))
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(all_).alias("_all"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = counts.withColumn("_in", F.sum("_n").over(inside)).join(sums, same)
    return joined.select(*keys, value, "_n", (F.col("_start") + F.col("_in")).alias("_upto"), "_all")


def interpolated(value: str, share: float) -> Column:
    """An aggregate over `ranked` rows: the value at place (n - 1) * share, between two neighbours if need be."""
    place = (F.col("_all") - 1) * share
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    low, high = at(F.floor(place)), at(F.ceil(place))
    return low + (high - low) * F.max(place - F.floor(place))


def nearest_rank(value: str, share: float) -> Column:
    """An aggregate over `ranked` rows: the value of rank int(n * share), at least the first."""
    return F.min(F.when(F.col("_upto") >= F.greatest(F.floor(F.col("_all") * share), F.lit(1)), F.col(value)))


def combined_rate(serial: list[Column], overlapped: list[Column]) -> Column:
    """Stages that overlap run at the slowest one's rate; stages in series add their times. A rate of zero is unknown: it is left out of overlaps, and makes a series zero."""
    out = overlapped[0]
    for r in overlapped[1:]:
        out = F.when((out > 0) & (r > 0), F.least(out, r)).otherwise(F.greatest(out, r))
    for r in serial:
        out = F.when((out > 0) & (r > 0), 1 / (1 / out + 1 / r)).otherwise(F.lit(0.0))
    return out


def lag_sums(rows: DataFrame, most: int, span: int = 4096) -> DataFrame:
    """session, lag and, over the pairs of a frame and the frame `lag` after it: overlap (how many), and the sums ab, aa and bb of products, nulls aside.

    rows: session, frame (from 0, distinct), a, b; lags go from -most to most. A session is cut into stretches of `span`
    frames, each with the `most` about it, so rows move once or twice, never once for each lag, and a long session is
    many pieces of work. A stretch gives a sum for each lag, and these add up.
    """
    if not 0 <= most <= span:
        raise ValueError("most must be from 0 to span")
    first, last = F.greatest(F.lit(0), F.expr(f"(frame - {most}) div {span}")), F.expr(f"(frame + {most}) div {span}")
    dealt = rows.select("session", "frame", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.explode(F.sequence(first, last)).alias("stretch"))
    pieces = dealt.groupBy("session", "stretch").agg(F.collect_list(F.struct("frame", "a", "b")).alias("rows"))
    names = ("overlap", "products", "ab", "aa", "bb")

    def plain(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        """The sums lag by lag, so that what is not finite counts only where it meets a partner."""
        n, out = len(left[0]), []
        for k in range(len(right[0]) - n + 1):
            there, known, y = (v[k : k + n] for v in right)
            met = (left[0] > 0) & (there > 0)
            both, x = met & (left[1] > 0) & (known > 0), left[2]
            out.append((met.sum(), both.sum(), (x[both] * y[both]).sum(), (x[met] * x[met]).sum(), (y[met] * y[met]).sum()))
        return list(np.array(out, dtype=float).T)

    def of(stretch: int, frame: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        own = frame // span == stretch
        if not own.any():
            return np.zeros(0, np.int64), [np.zeros(0)] * len(names)
        start, n = frame[own].min(), int(frame[own].max() - frame[own].min() + 1)
        reach = min(most, int(max(start + n - 1 - frame.min(), frame.max() - start)))
        at, beside = frame[own] - start, frame - start + reach
        near = (beside >= 0) & (beside < n + 2 * reach)

        def line(size: int, where: np.ndarray, values: np.ndarray) -> np.ndarray:
            out = np.zeros(size)
            out[where] = values
            return out

        left = [line(n, at, v) for v in (np.ones(len(at)), a[0][own], a[1][own])]
        right = [line(n + 2 * reach, beside[near], v) for v in (np.ones(near.sum()), b[0][near], b[1][near])]
        if np.isfinite(left[2]).all() and np.isfinite(right[2]).all():
            sums = [np.correlate(y, x) for y, x in ((right[0], left[0]), (right[1], left[1]), (right[2], left[2]), (right[0], left[2] * left[2]), (right[2] * right[2], left[0]))]
        else:
            sums = plain(left, right)
        lags = np.arange(-reach, reach + 1)
        met = sums[0] > 0.5
        return lags[met], [x[met] for x in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            ends, flat = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]), lists.flatten()
            frame = flat.field(0).to_numpy(zero_copy_only=False)
            a, b = ([x.to_numpy(zero_copy_only=False) for x in (flat.field(i).is_valid(), flat.field(i).fill_null(0.0))] for i in (1, 2))
            made = [of(s, frame[i:j], [x[i:j] for x in a], [x[i:j] for x in b]) for s, i, j in zip(batch.column("stretch").to_pylist(), ends, ends[1:], strict=False)]
            session = batch.column("session").take(pa.array(np.repeat(np.arange(batch.num_rows), [len(lags) for lags, _ in made])))
            sums = [np.concatenate([np.zeros(0), *(sums[k] for _, sums in made)]) for k in range(len(names))]
            lags = np.concatenate([np.zeros(0, np.int64), *(lags for lags, _ in made)])
            yield pa.RecordBatch.from_arrays([session, pa.array(lags), *(pa.array(np.rint(x).astype(np.int64) if k < 2 else x) for k, x in enumerate(sums))], names=["session", "lag", *names])

    kind = rows.schema["session"].dataType.simpleString()
    parts = pieces.mapInArrow(run, f"session {kind}, lag long, overlap long, products long, ab double, aa double, bb double")
    return parts.groupBy("session", "lag").agg(F.sum("overlap").alias("overlap"), F.when(F.sum("products") > 0, F.sum("ab")).alias("ab"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"))
