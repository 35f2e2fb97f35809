"""Rules that split: any span of the stretches gives what a plain loop over the whole key gives."""

import math
import random

import pytest

from cadenza.operators import sequences


def frames(n, seed, gap=False):
    random.seed(seed)
    at, rows = 0, []
    for _ in range(n):
        rows.append((at, random.random(), random.uniform(0.35, 1), random.random() < 0.02, random.random()))
        at += random.choice([1, 1, 900]) if gap else 1
    return rows


KEYED = [(k, *row) for k, n, gap in ((1, 700, False), (2, 1, False), (None, 90, True), (3, 256, False)) for row in frames(n, n, gap)]
SCHEMA = "session long, frame long, confidence double, target double, cut boolean, motion double"


def loops(one):
    """one(rows of a key) gives its results by frame."""
    out = {}
    for key in {r[0] for r in KEYED}:
        own = [r for r in KEYED if r[0] == key]
        out |= {(key, r[1]): made for r, made in zip(own, one(own), strict=True)}
    return out


def close(found, wanted):
    assert found.keys() == wanted.keys()
    assert all(math.isclose(found[k], wanted[k], rel_tol=1e-12) for k in wanted)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(KEYED, SCHEMA).repartition(5)


@pytest.mark.parametrize("span", [1, 7, 64, 65_536])
def test_means(rows, span):
    def one(own):
        last = None
        for r in own:
            last = r[3] if last is None else r[3] * (1 - 0.9) + last * 0.9
            yield last

    found = sequences.ema(rows, ["session"], ["target", "motion"], ["mean", "other"], 0.9, ["session", "frame"], span=span).collect()
    close({(r.session, r.frame): r["mean"] for r in found}, loops(one))


@pytest.mark.parametrize("span", [1, 7, 64])
def test_blends(rows, span):
    def one(own):
        last = None
        for r in own:
            share = min(max(0.85 * r[2], 0), 0.75)
            last = r[3] if last is None else r[3] * (1 - share) + last * share
            yield last

    found = sequences.blended(rows.selectExpr("session", "0 as scene", "frame", "confidence", "target as value"), span=span).collect()
    close({(r.session, r.frame): r.blended for r in found}, loops(one))


@pytest.mark.parametrize("span", [1, 7, 64, 300])
def test_levels(rows, span):
    def one(own):
        level = None
        for r in own:
            level = r[3] if level is None else level + (r[3] - level) * (0.55 if r[3] < level else 0.30)
            yield level

    close({(r.session, r.frame): r.level for r in sequences.asymmetric_follow(rows, span=span).collect()}, loops(one))


def test_level_out_of_bounds(rows):
    with pytest.raises(Exception, match="outside"):
        sequences.asymmetric_follow(rows, low=0.5).collect()


@pytest.mark.parametrize(("interval", "least", "low"), [(8, 3, 0.1), (24, 3, 0.02), (5, 9, 0.5), (1, 1, 0.0), (12, 1, 0.05)])
@pytest.mark.parametrize("span", [1, 7, 64])
def test_schedules(rows, interval, least, low, span):
    def one(own):
        since = 1_000_000
        for _, _, confidence, _, cut, motion in own:
            fresh = cut or since >= interval - 1 or (since >= least - 1 and (confidence < low or motion > 0.95))
            since = 0 if fresh else since + 1
            yield fresh, since

    found = sequences.refresh_schedule(rows, interval, least, low, 0.95, span=span).collect()
    assert {(r.session, r.frame): (r.refresh, r.since) for r in found} == loops(one)


def test_empty(spark, rows):
    none = rows.limit(0)
    assert sequences.asymmetric_follow(none).collect() == [] == sequences.refresh_schedule(none, 8, 3, 0.1, 0.9).collect()


def test_a_long_session_is_many_tasks(spark):
    """A session of 400,000 frames in stretches of 10,000: its rows are dealt over tasks, and the split changes nothing."""
    rows = spark.range(400_000).selectExpr("1L as session", "id as frame", "pmod(hash(id), 1000) / 1000D as target")
    out = sequences.asymmetric_follow(rows, span=10_000).selectExpr("*", "spark_partition_id() as task").cache()
    assert out.select("task").distinct().count() > 1
    whole = sequences.asymmetric_follow(rows, span=1_000_000)
    far = out.join(whole.withColumnRenamed("level", "wanted"), ["session", "frame"]).where("abs(level - wanted) > 1e-12")
    assert out.count() == 400_000 and far.count() == 0
    out.unpersist()
