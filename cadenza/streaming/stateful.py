"""Structured Streaming versions of the folds: a step function of a small typed state, keyed by session, with timers.

The state crosses micro-batches, rows of a session are taken in order of frame, and a frame that is not the next one of
its session raises an error, as late or missing frames do in the reader that feeds a session. So the result does not
depend on where micro-batches end, and equals the batch fold's. A session that is silent can raise an alarm and lose its
state by a timer, in processing time or, by a watermark, in event time; what it says does not depend on the batches either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start queries with typed state in this block: they need RocksDB as state store."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


class _Fold(StatefulProcessor):
    """A fold of one key; `idle` processing-time seconds without rows end it."""

    def __init__(self, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], state: T.StructType, columns: list[str], added: list[str], strict: bool, idle: float | None):
        self.start, self.step, self.fields, self.columns, self.added, self.strict, self.idle = start, step, state, columns, added, strict, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", T.StructType([T.StructField("after", T.LongType()), T.StructField("begun", T.BooleanType()), *self.fields.fields]))

    def _value(self, kept: tuple) -> Any:
        _, begun, *values = kept
        if not begun:
            return None
        return values[0] if len(self.fields.fields) == 1 else tuple(values)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            kept = self.state.get()
            after, value = kept[0], self._value(kept)
        else:
            after, value = -1, self.start()
        waiting: dict[int, dict] = {}  # rows that came before the one that is due; a stream in order has none
        for frame in rows:
            out = []
            for row in frame.to_dict("records"):
                waiting[row["frame"]] = row
                while self.strict and (due := waiting.pop(after + 1, None)) is not None:
                    after, (value, made) = after + 1, self.step(value, due)
                    out.append({c: due[c] for c in self.columns} | made)
            if out:
                yield pd.DataFrame(out, columns=[*self.columns, *self.added])
        if self.strict and waiting:
            raise ValueError(f"session {key[0]}: frame {min(waiting)} follows {after}")
        out = []
        for at in sorted(waiting):
            after, (value, made) = at, self.step(value, waiting[at])
            out.append({c: waiting[at][c] for c in self.columns} | made)
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, *self.added])
        values = [None] * len(self.fields.fields) if value is None else list(value) if isinstance(value, tuple) else [value]
        self.state.update((int(after), value is not None, *values))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + round(1000 * self.idle))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded(stream: DataFrame, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], fields: str, columns: list[str], state: str, strict: bool = True, idle: float | None = None) -> DataFrame:
    """Rows of a stream (session, frame, ...) with the columns that `step` makes. Start it inside `state_store`.

    state: the types of the step's state, one field or a tuple's; None is kept as such. With `idle`, the state of a
    session without rows for so many seconds is removed; a session that comes back starts anew, at frame 0.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*(stream.schema[c] for c in columns), *added.fields])
    one = _Fold(start, step, T.StructType.fromDDL(state), columns, added.names, strict, idle)
    return stream.groupBy("session").transformWithStateInPandas(one, schema, "append", "None" if idle is None else "ProcessingTime")


class _Watch(StatefulProcessor):
    """The last event of one key, and a timer `idle` after it; times are milliseconds."""

    def __init__(self, idle: int, event_time: bool):
        self.idle, self.event_time = idle, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "seen long, rows long")

    def _alarm(self, key: Any, seen: int, rows: int) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]], "since_ms": [seen], "rows": [rows]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, n = self.state.get() if self.state.exists() else (None, 0)
        if self.event_time:
            # A pause inside what arrives together is the same alarm as one that a timer finds. Only times are held.
            for at in sorted(t for frame in rows for t in frame["at_ms"].tolist()):
                if seen is not None and at - seen > self.idle:
                    yield self._alarm(key, seen, n)
                    n = 0
                seen, n = at if seen is None else max(seen, at), n + 1
        else:
            n += sum(map(len, rows))
            seen = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((int(seen), int(n)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(seen) + self.idle + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            yield self._alarm(key, *self.state.get())
            self.state.clear()

    def close(self) -> None:
        pass


def silent(stream: DataFrame, idle_ms: int, at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """An alarm (session, since_ms, rows) for each pause of a session of over `idle_ms`, without waiting for its next row. Start it inside `state_store`.

    With `at`, a timestamp column, pauses are in event time, taken to the nearest millisecond (half of one goes away from zero; rows without
    a time do not count), and a timer fires when the watermark, `late` behind the newest event, has passed it; else they
    are in processing time. `rows` have come since the alarm before. A session's state goes with its alarm.
    """
    if at is None:
        return stream.groupBy("session").transformWithStateInPandas(_Watch(idle_ms, False), "session long, since_ms long, rows long", "append", "ProcessingTime")
    nearest = F.timestamp_micros(F.round(F.unix_micros(at), -3))
    rows = stream.where(F.col(at).isNotNull()).withColumn(at, nearest).withWatermark(at, late).select("session", at, F.unix_millis(at).alias("at_ms"))
    return rows.groupBy("session").transformWithStateInPandas(_Watch(idle_ms, True), "session long, since_ms long, rows long", "append", "EventTime")


def windowed_counts(stream: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts and mean values by kind in event-time windows, with a watermark. For feeds that may be late; sessions' own windows are closed by data (see `telemetry.rate_step`)."""
    at = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return at.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "events", "mean_value")


def session_windows(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """Episodes of a user with no pause of `gap` or longer."""
    at = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
