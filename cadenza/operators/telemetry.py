"""State that telemetry events drive: windows that data close, episodes, flags, alarms, prefetch.

What depends on the result before it is a step function of a small state; `sequences.fold` runs it in batch, and
`streaming.stateful` runs the very same function in a stream, so results do not depend on how a stream is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import fold, ordered, so_far


def rate_step(least_span: float):
    """Frames per second over windows that close at the first frame at least `least_span` after their start."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, dict]:
        t = row["t"]
        if state is None:
            return (t, 0), {"closed": False, "fps": None}
        start, frames = state[0], state[1] + 1
        if t - start >= least_span:
            return (t, 0), {"closed": True, "fps": frames / (t - start)}
        return (start, frames), {"closed": False, "fps": None}

    return step


def data_windows(df: DataFrame, least_span: float) -> DataFrame:
    """The closed windows of each session: (session, frame, t, fps)."""
    out = fold(df, ["session"], lambda: None, rate_step(least_span), "closed boolean, fps double", ["session", "frame", "t"])
    return out.where("closed").drop("closed")


def alarm_step(limit: float, lasting: float, pause: float):
    """An alarm once a drift is over its limit for `lasting`, and at most one each `pause`."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        since, last = state
        t = row["t"]
        if abs(row["drift"]) <= limit:
            return (None, last), {"alarm": False}
        since = t if since is None else since
        fire = t - since >= lasting and (last is None or t - last >= pause)
        return (since, t if fire else last), {"alarm": fire}

    return step


def prefetch_step(state: tuple, row: dict) -> tuple[tuple, dict]:
    """Scheduled indexes in order; taking one discards those before it. A miss discards those after it."""
    pending = list(state)
    at = row["index"]
    if row["action"] == "schedule":
        if at not in pending:
            pending.append(at)
        return tuple(sorted(pending)), {"hit": None, "discarded": 0, "pending": len(pending)}
    hit = at in pending
    kept = [i for i in pending if i > at] if hit else [i for i in pending if i < at]
    return tuple(kept), {"hit": hit, "discarded": len(pending) - len(kept) - int(hit), "pending": len(kept)}


def flags(df: DataFrame, on: dict[str, Column], off: dict[str, Column]) -> DataFrame:
    """For each name, whether the last event that switched it switched it on; false before any."""
    for name in on:
        switched = F.when(on[name], True).when(off[name], False)
        df = df.withColumn(name, F.coalesce(F.last(switched, ignorenulls=True).over(so_far("session")), F.lit(False)))
    return df


def episodes(df: DataFrame, inside: Column) -> DataFrame:
    """Runs of consecutive frames that are inside: first, last, length."""
    d = df.withColumn("_in", inside)
    start = d.withColumn("_start", F.col("_in") & ~F.coalesce(F.lag("_in").over(ordered("session")), F.lit(False)))
    numbered = start.withColumn("episode", F.sum(F.col("_start").cast("int")).over(so_far("session")))
    return numbered.where("_in").groupBy("session", "episode").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"), F.max("k").alias("longest_wait"))
