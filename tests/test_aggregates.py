"""Ranked aggregates against numpy: ties, nulls, one value, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import aggregates, joins, splat
from cadenza.operators import aggregates as A


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"many": rng.normal(size=501).tolist(), "ties": [1.0] * 90 + [2.0] * 10, "one": [7.0], "even": [1.0, 2.0, 3.0, 10.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("many", None), ("nulls", None)]
    r = A.ranked(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v")
    out = r.groupBy("k").agg(*(A.interpolated("v", p).alias(f"q{i}") for i, p in enumerate((0.0, 0.02, 0.5, 0.98, 1.0))), A.nearest_rank("v", 0.95).alias("p95"))
    got = {x.k: x for x in out.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([got[k][f"q{i}"] for i in range(5)], np.quantile(vs, [0, 0.02, 0.5, 0.98, 1])), k
        assert got[k].p95 == sorted(vs)[max(int(len(vs) * 0.95), 1) - 1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert A.ranked(empty, ["k"], "v").groupBy("k").agg(F.count("*"), A.interpolated("v", 0.5)).count() == 0


@pytest.mark.parametrize("low_high", [(0, 1), (1000, 1010), (-1e9, 1e9)])
def test_ranges_fit_the_values(spark, monkeypatch, low_high):
    """As many rows in each range, wherever the values lie; ranks are exact over them."""
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 500)
    low, high = low_high
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.uniform(low, high, 10_000)] + [float(low)] * 700 + [None] * 5
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    column, n = aggregates.ranges_of(df, "v")
    sizes = [r["count"] for r in df.where("v is not null").groupBy(column.alias("r")).count().collect()]
    assert n >= 20 and len(sizes) >= 20 and max(sizes) <= 1500
    got = {(r.k, r.v): (r["_upto"], r["_all"]) for r in aggregates.ranked(df, ["k"], "v").collect()}
    for k in range(3):
        mine = sorted(v for i, v in enumerate(values) if i % 3 == k and v is not None)
        assert all(got[k, v] == (int(np.searchsorted(mine, v, side="right")), len(mine)) for v in mine[::97])


def test_nearest_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 20)
    rng = np.random.default_rng(5)
    values = [(float(v), i) for i, v in enumerate(rng.random(150))]
    probes = [(i, float(v)) for i, v in enumerate(rng.random(300))] + [(900, -5.0), (901, 7.0)]
    out = joins.nearest(spark.createDataFrame(probes, "id long, at double"), spark.createDataFrame(values, "at double, source int"), "at", "source").collect()
    assert {r.id: (r.distance, r.source) for r in out} == {i: min((abs(v - p), s) for v, s in values) for i, p in probes}


def test_one_pass_over_targets_and_codes(spark):
    """A splat joins nothing; matching codes runs Python once and crosses nothing."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (1, 0.5, 1.0, 4.0), (1, 0.2, 0.5, 9.0), (2, 0.1, 0.01, 1.0)], "target long, layer double, weight double, colour double")
    out = splat.splat(rows, 0.05)
    assert "Join" not in plan(out)
    assert {r.target: (r.front, r.hits, r.coverage, r.near, r.far, r.valid) for r in out.collect()} == {1: (0.5, 2, 2.0, 3.0, 9.0, True), 2: (0.1, 1, 0.01, 1.0, 1.0, False)}
    codes = spark.range(100).selectExpr("id", "id * 7919 as code")
    text = plan(joins.nearest_two(codes.where("id % 20 = 0"), codes, 0.7, query_rows=2, rows=16))
    assert text.count("MapInArrow") == 1 and "NestedLoop" not in text and "Cartesian" not in text and "WindowGroupLimit" in text


@pytest.mark.parametrize("span", [8, 4096])
def test_lag_sums_equal_plain_loops(spark, span):
    """Sessions longer and shorter than a stretch, with nulls and what is not finite; rows are not multiplied by lags."""
    rows = [(s, i, float((i * 7 + s) % 11 - 5), float((i * 5 + 2 * s) % 9 - 4)) for s, n in ((0, 40), (1, 5), (2, 1), (3, 21)) for i in range(n)]
    rows = [(s, i, None if s == 0 and i % 6 == 1 else float("inf") if (s, i) == (3, 4) else a, None if s == 0 and i % 5 == 2 or s == 2 else b) for s, i, a, b in rows]
    out = A.lag_sums(spark.createDataFrame(rows, "session long, frame long, a double, b double"), 7, span)
    got = {(r.session, r.lag): (r.overlap, r.ab, r.aa, r.bb) for r in out.collect()}
    expected = {}
    for s in range(4):
        one = {i: (a, b) for t, i, a, b in rows if t == s}
        for lag in range(-7, 8):
            pairs = [(one[i][0], one[i + lag][1]) for i in one if i + lag in one]
            if pairs:
                ab = [a * b for a, b in pairs if a is not None and b is not None]
                expected[s, lag] = (len(pairs), sum(ab) if ab else None, sum(a * a for a, _ in pairs if a is not None), sum(b * b for _, b in pairs if b is not None))
    assert got.keys() == expected.keys()
    for key, numbers in expected.items():
        assert got[key] == pytest.approx(numbers, nan_ok=True), key
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
