"""A stream's result does not depend on how it is cut, and equals the batch's."""

import datetime
import time

import pytest

from cadenza.operators import sequences, telemetry
from cadenza.streaming import stateful

ROWS = [(s, i, float(i) * (1.3 if i % 3 else 0.7) + s, float((i * 37 + s) % 90) - 45) for s in range(3) for i in range(24)]
SCHEMA = "session long, frame long, t double, drift double"


def run(spark, tmp_path, cuts, make):
    source, name = tmp_path / f"in{len(cuts)}", f"out_{tmp_path.name.replace('-', '_')}_{len(cuts)}"
    source.mkdir()
    edges = [0, *cuts, 24]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    with stateful.state_store(spark):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{len(cuts)}")).start()
    try:
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            part = [r for r in ROWS if a <= r[1] < b]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{len(cuts)}{i}"))
            next((tmp_path / f"w{len(cuts)}{i}").glob("*.parquet")).rename(source / f"{i}.parquet")
            query.processAllAvailable()
        return sorted(map(tuple, spark.table(name).collect()))
    finally:
        query.stop()


@pytest.mark.parametrize("cuts", [[], [5, 6, 17]])
def test_windows_equal_batch(spark, tmp_path, cuts):
    step = telemetry.rate_step(4.0)
    batch = sequences.fold(spark.createDataFrame(ROWS, SCHEMA), ["session"], lambda: None, step, "closed boolean, fps double", ["session", "frame"])
    got = run(spark, tmp_path, cuts, lambda s: stateful.folded(s, lambda: None, step, "closed boolean, fps double", ["session", "frame"], "began double, frames long").where("closed"))
    assert got == sorted(map(tuple, batch.where("closed").collect())) and got


def test_alarm_equals_batch(spark, tmp_path):
    step = telemetry.alarm_step(20, 1.0, 6.0)
    batch = sequences.fold(spark.createDataFrame(ROWS, SCHEMA), ["session"], lambda: (None, None), step, "alarm boolean", ["session", "frame"])
    got = run(spark, tmp_path, [3, 4, 9], lambda s: stateful.folded(s, lambda: (None, None), step, "alarm boolean", ["session", "frame"], "since double, last double"))
    assert got == sorted(map(tuple, batch.collect())) and any(r[2] for r in got)


def test_gap_is_an_error(spark, tmp_path):
    rows = [(0, 0, 0.0, 0.0), (0, 2, 2.0, 0.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = stateful.folded(stream, lambda: None, telemetry.rate_step(1.0), "closed boolean, fps double", ["session", "frame"], "began double, frames long")
    with stateful.state_store(spark):
        query = out.writeStream.format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="follows"):
        query.processAllAvailable()


def started(spark, tmp_path, name, df):
    with stateful.state_store(spark):
        return df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"k_{name}")).start()


def put(spark, tmp_path, source, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{source.name}_{n}"))
    next((tmp_path / f"{source.name}_{n}").glob("*.parquet")).rename(source / f"{n}.parquet")


def until(what, seconds=60):
    end = time.monotonic() + seconds
    while not what():
        assert time.monotonic() < end, "it took too long"
        time.sleep(0.2)


def test_a_silent_session_raises_its_alarm_without_a_row(spark, tmp_path):
    """By processing time: no row comes after the first ones, and yet the alarm does; its state goes."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("session long, v long").parquet(str(source))
    query = started(spark, tmp_path, "silence", stateful.silent(stream, 1500))
    try:
        put(spark, tmp_path, source, 0, [(1, 1), (1, 2), (2, 1)], "session long, v long")
        until(lambda: spark.table("silence").count() == 2)
        assert sorted((r.session, r.rows) for r in spark.table("silence").collect()) == [(1, 2), (2, 1)]
        until(lambda: sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) == 0)
        put(spark, tmp_path, source, 1, [(2, 5)], "session long, v long")
        until(lambda: spark.table("silence").count() == 3)
        assert [(r.session, r.rows) for r in spark.table("silence").collect()][-1] == (2, 1)
    finally:
        query.stop()


PAUSES = [(s, 1000 + s * 7 + t) for s in range(3) for t in (0, 3, 4, 30, 31, 90, 91 + 20 * s, 150)]


@pytest.mark.parametrize("edges", [[], [20], [5, 35, 36, 120], [1, 2, 3, 4, 60, 100, 130]])
def test_pauses_do_not_depend_on_the_cut(spark, tmp_path, edges):
    """By event time: alarms are the pauses of over 20 s, and the last silence once the watermark has passed it."""
    source = tmp_path / f"in{len(edges)}"
    source.mkdir()
    stream = spark.readStream.schema("session long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = started(spark, tmp_path, f"pauses{len(edges)}", stateful.silent(stream, 20_000, "at"))
    rows = [(s, datetime.datetime.fromtimestamp(t, datetime.UTC)) for s, t in sorted(PAUSES, key=lambda r: r[1])]
    try:
        for i, (a, b) in enumerate(zip([-1, *edges], [*edges, 999], strict=True)):
            put(spark, tmp_path, source, i, [r for r in rows if a < r[1].timestamp() - 1000 <= b], "session long, at timestamp")
            query.processAllAvailable()
        put(spark, tmp_path, source, 99, [(9, datetime.datetime.fromtimestamp(1400, datetime.UTC))], "session long, at timestamp")
        query.processAllAvailable()
        until(lambda: spark.table(f"pauses{len(edges)}").where("since_ms > 1149000").count() == 3)
    finally:
        query.stop()
    expected = []
    for s in range(3):
        times = sorted(t for q, t in PAUSES if q == s) + [10_000]
        n = 0
        for now, after in zip(times, times[1:], strict=False):
            n += 1
            if after - now > 20:
                expected.append((s, now * 1000, n))
                n = 0
    assert sorted(map(tuple, spark.table(f"pauses{len(edges)}").collect())) == sorted(expected)


def test_times_are_taken_to_the_nearest_millisecond(spark, tmp_path):
    """As the SQL takes them: half a millisecond and more count up, in the alarm, in a pause and in the watermark."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("session long, at timestamp").parquet(str(source))
    query = started(spark, tmp_path, "nearest", stateful.silent(stream, 20_000, "at", "1 second"))
    # Session 1 pauses for 20 s and, rounded, a millisecond; 2 rounded for 20 s. The mark is 21000 + 20001: 3 is one millisecond before it, 4 is not.
    micros = [(1, 0), (1, 20_000_500), (1, 21_000_500), (2, 500), (2, 20_000_600), (2, 21_001_000), (3, 20_999_900), (4, 21_001_499), (5, 42_000_500), (6, None)]
    try:
        put(spark, tmp_path, source, 0, [(s, None if t is None else datetime.datetime.fromtimestamp(1000, datetime.UTC) + datetime.timedelta(microseconds=t)) for s, t in micros], "session long, at timestamp")
        query.processAllAvailable()
        until(lambda: spark.table("nearest").count() >= 2)
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("nearest").collect())) == [(1, 1_000_000, 1), (3, 1_021_000, 1)]


def test_idle_state_goes(spark, tmp_path):
    """A fold whose session is silent loses its state and starts anew at frame 0."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    step = lambda n, row: (n + 1, {"n": n + 1})
    query = started(spark, tmp_path, "idle", stateful.folded(stream, lambda: 0, step, "n long", ["session", "frame"], "n long", idle=1.5))
    try:
        put(spark, tmp_path, source, 0, ROWS[:3], SCHEMA)
        until(lambda: spark.table("idle").count() == 3 and query.lastProgress and sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) == 0)
        put(spark, tmp_path, source, 1, ROWS[:2], SCHEMA)
        until(lambda: spark.table("idle").count() == 5)
        assert sorted(r.n for r in spark.table("idle").collect()) == [1, 1, 2, 2, 3]
    finally:
        query.stop()


def test_event_time_windows(spark, sf_dir, tmp_path):
    events = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(events).schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(open(events, "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stateful.windowed_counts(stream, "1 hour", "1 day").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.events for r in spark.table("days").collect()) == spark.read.parquet(events).count()
    assert stateful.session_windows(spark.read.parquet(events), "1 hour", "2 hours").count() > 0
