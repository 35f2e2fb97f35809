"""Operators on ordered sequences: rows of a session in order of frame.

State never crosses a session. What a window can say is a window; a rule whose next value depends on its last result is
a scan over stretches where a stretch of rows sums up to a small value, else a fold (`scans`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scans import SPAN, fold, following, scan, scheduled, weighted  # noqa: F401


def ordered(*keys: str, by: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def so_far(*keys: str, by: str = "frame") -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def with_scene(df: DataFrame, cut: Column, name: str = "scene") -> DataFrame:
    """Number the scenes of each session; a scene starts where `cut` is true. The first frame starts none."""
    return df.withColumn(name, F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(so_far("session")))


def change(column: str) -> Column:
    """Absolute change from the frame before; null on a session's first frame."""
    return F.abs(F.col(column) - F.lag(column).over(ordered("session")))


def since_cut(df: DataFrame, ramp: int) -> DataFrame:
    """Frames since the last cut. A session starts as if its ramp were over, so scene 0 counts on from `ramp`."""
    at = F.row_number().over(ordered("session", "scene"))
    return df.withColumn("since_cut", F.when(F.col("scene") == 0, at + ramp).otherwise(at - 1).cast("long"))


def carried(df: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """The last value that is not null, so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(so_far(*keys)))


def filled(value: Column, keys: list[str], along: str, from_right: bool) -> Column:
    """value, or the nearest one that is not null on the preferred side, or else on the other."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(along).rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(value, after, before) if from_right else F.coalesce(value, before, after)


def runs(df: DataFrame, keys: list[str], along: str) -> DataFrame:
    """First, last and length of each run of consecutive `along` values."""
    island = F.col(along) - F.row_number().over(Window.partitionBy(*keys).orderBy(along))
    grouped = df.withColumn("_island", island).groupBy(*keys, "_island")
    return grouped.agg(F.min(along).alias("first"), F.max(along).alias("last"), F.count("*").alias("length")).drop("_island")


def ema(df: DataFrame, keys: list[str], values: list[str], names: list[str], smoothing: float, columns: list[str], span: int = SPAN) -> DataFrame:
    """Exponential means: the first value, then value * (1 - smoothing) + previous * smoothing."""
    return scan(df.withColumn("_share", F.lit(smoothing)), keys, weighted("_share", values, names), columns, span=span)


def refresh_schedule(df: DataFrame, interval: int, least: int, confidence_below: float, motion_above: float, span: int = SPAN) -> DataFrame:
    """Where to compute anew: at the start, at a cut, periodically, or early where confidence is low or motion high. What is null is neither."""
    early = (F.col("confidence") < confidence_below) | (F.col("motion") > motion_above)
    rows = df.withColumn("_cut", F.coalesce("cut", F.lit(False))).withColumn("_early", F.coalesce(early, F.lit(False)))
    return scan(rows, ["session"], scheduled("_cut", "_early", interval, least), ["session", "frame"], span=span)


#: So many frames since the last refresh at a session's start.
NEVER = 1_000_000


def refresh_step(interval: int, least: int, confidence_below: float, motion_above: float) -> Callable[[int, dict], tuple[int, dict]]:
    def step(since: int, row: dict) -> tuple[int, dict]:
        early = since >= least - 1 and (row["confidence"] < confidence_below or row["motion"] > motion_above)
        fresh = bool(row["cut"] or since >= interval - 1 or early)
        since = 0 if fresh else since + 1
        return since, {"refresh": fresh, "since": since}

    return step


def asymmetric_follow(df: DataFrame, falling: float = 0.55, rising: float = 0.30, low: float = 0.0, high: float = 1.0, span: int = SPAN) -> DataFrame:
    """A level that follows `target`, in [low, high], faster when it falls than when it rises; starts at the first target."""
    return scan(df, ["session"], following("target", "level", falling, rising, low, high), ["session", "frame", "target"], span=span)


def blended(df: DataFrame, strength: float = 0.85, most: float = 0.75, span: int = SPAN) -> DataFrame:
    """Each frame's value blended with the previous result by its confidence; nothing to blend on the first frame."""
    share = F.least(F.greatest(strength * F.col("confidence"), F.lit(0.0)), F.lit(most))
    return scan(df.withColumn("_share", share), ["session", "scene"], weighted("_share", ["value"], ["blended"]), ["session", "frame"], span=span)


def trailing_rate(df: DataFrame, seconds: float = 3.0, least_span: float = 0.25) -> DataFrame:
    """Frames per second over the trailing `seconds`; frames / t while there is one sample; null where the span is too short (kept from before)."""
    ticks = F.round(F.col("t") * 1_000_000).cast("long")
    w = Window.partitionBy("session").orderBy(ticks).rangeBetween(-round(seconds * 1_000_000), 0)
    n, first_t, first_f = F.count("*").over(w), F.min("t").over(w), F.min("frame").over(w)
    last_f, span = F.max("frame").over(w), F.col("t") - F.min("t").over(w)
    rate = F.when((n >= 2) & (span >= least_span), (last_f - first_f) / span).when((n < 2) & (F.col("t") > least_span), F.col("frame") / F.col("t"))
    return df.withColumn("now", rate).withColumn("rate", F.last("now", ignorenulls=True).over(so_far("session"))).drop("now")


def owned_windows(frames: DataFrame, keys: Sequence[str], owned: int = 6, beside: int = 3, donors: int = 3) -> DataFrame:
    """keys, start, outputs, order, frame, first_donor, last_donor: windows that own `owned` frames each and see `beside` more on either side.

    Windows follow each other from a key's first frame; the last owns what is left. The frames seen are clamped to the
    key's ends, so edges repeat, and `order` counts them, outputs from `beside` on. Donors of what is seen lie up to
    `donors` frames farther. Frames of a key have no gaps. A row per window and place; one sum a key, no window over it.
    """
    ends = frames.groupBy(*keys).agg(F.min("frame").alias("_first"), F.max("frame").alias("_last"))
    starts = ends.withColumn("start", F.explode(F.sequence("_first", "_last", F.lit(owned).cast("long"))))
    clamped = lambda v: F.greatest(F.col("_first"), F.least(F.col("_last"), v))
    seen = starts.select(*keys, "_first", "_last", "start", F.posexplode(F.sequence(F.lit(-beside), F.lit(owned + beside - 1))).alias("order", "_offset"))
    reach = beside + donors
    return seen.select(
        *keys, "start", F.least(F.lit(owned).cast("long"), F.col("_last") - F.col("start") + 1).alias("outputs"), "order", clamped(F.col("start") + F.col("_offset")).alias("frame"),
        clamped(F.col("start") - reach).alias("first_donor"), clamped(F.col("start") + owned - 1 + reach).alias("last_donor"),
    )


def chunk_plan(total: Column, size: int, first: int) -> Column:
    """Chunks of a run: the first has `first` frames if that is fewer, then `size` each, the rest last."""
    start = F.least(F.lit(first), F.lit(size))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.when(total > start, F.sequence(start.cast("long"), (total - 1).cast("long"), F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>")))
    ends = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0))), F.array(total.cast("long")))
    return F.arrays_zip(begins.alias("first"), ends.alias("end"))


def lagged(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """`rows` and `name`, the value of the row before it of its keys in order of a whole number.

    A key may hold a third of the rows, so windows span stretches of `span` numbers only; a stretch's first row takes
    the last value of the stretch before, of which there is one each.
    """
    r = rows.withColumn("_stretch", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order)
    ends = r.groupBy(*keys, "_stretch").agg(F.max_by(value, order).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_stretch")))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_stretch").alias("_s"), "_end")
    same = F.col("_stretch") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = r.withColumn("_was", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside)).join(ends, same)
    return joined.withColumn(name, F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_was"))).select(*rows.columns, name)
