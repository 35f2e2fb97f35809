"""Homographies by consensus: planted maps, wrong matches, every reason."""

import numpy as np
import pytest

from cadenza.operators import consensus as R

TRUE = np.array([[1.05, 0.04, 0.02], [-0.03, 0.96, 0.05], [0.08, -0.05, 1.0]])
MATCHES, SIZES = "pair long, x double, y double, u double, v double", "pair long, width int, height int, described boolean"


def points(n, wrong, seed=0, region=(0, 639, 0, 359), matrix=TRUE):
    rng = np.random.default_rng(seed)
    p = np.stack([rng.uniform(region[0], region[1], n), rng.uniform(region[2], region[3], n)], axis=1)
    q = R.mapped(matrix[None], p / [639, 359])[0] * [639, 359]
    bad = rng.permutation(n) < round(n * wrong)
    q[bad] += rng.uniform(15, 200, (bad.sum(), 2)) * rng.choice([-1, 1], (bad.sum(), 2))
    return np.hstack([p, q]).tolist(), int(n - bad.sum())


def run(spark, sets, described=True, **options):
    matches = spark.createDataFrame([(i, *row) for i, rows in sets.items() for row in rows], MATCHES)
    sizes = spark.createDataFrame([(i, 640, 360, described) for i in sets], SIZES)
    return {r.pair: r for r in R.homographies(matches.repartition(3), sizes, **options).collect()}


def test_a_planted_map_is_found_among_wrong_matches(spark):
    sets, inliers = {}, {}
    for i in range(6):
        sets[i], inliers[i] = points(200 + i, 0.4, i)
    out = run(spark, sets, least_confidence=0.5)
    for i, r in out.items():
        assert r.reason is None and r.matches == 200 + i and inliers[i] <= r.inliers <= inliers[i] + 2
        assert np.allclose(np.reshape(r.m, (3, 3)), TRUE, atol=1e-6)
    assert {r.reason for r in run(spark, sets).values()} == {"low-confidence"}


def test_many_matches_are_sampled_but_all_counted(spark):
    sets = {0: points(20_000, 0.2, 5)[0]}
    r = run(spark, sets)[0]
    assert r.reason is None and r.matches == 20_000 and 16_000 <= r.inliers <= 16_010 and np.allclose(np.reshape(r.m, (3, 3)), TRUE, atol=1e-6)


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        (points(17, 0)[0], "few-matches"),
        (points(60, 0.8)[0], "few-inliers"),
        (points(60, 0, region=(0, 200, 0, 359))[0], "narrow-coverage"),
        (points(60, 0, region=(0, 639, 100, 160))[0], "narrow-coverage"),
        (points(60, 0.35)[0], "low-confidence"),
        (points(60, 0, matrix=np.diag([0.2, 0.2, 1.0]))[0], "low-confidence"),
        ([[1.0, 2.0, 3.0, 4.0]] * 40, "few-inliers"),
        ([], "few-matches"),
    ],
)
def test_reasons(spark, rows, reason):
    r = run(spark, {0: rows, 1: points(40, 0)[0]})
    assert r[0].reason in (reason, "narrow-coverage" if len(rows) == 40 else reason) and r[0].m is None and r[1].reason is None
    assert run(spark, {0: rows}, described=False)[0].reason == "no-features"


def test_sets_of_four():
    rng = np.random.default_rng(1)
    p = rng.random((50, 4, 2))
    q = np.stack([R.mapped(TRUE[None], s)[0] for s in p])
    m = R.solved(p, q)
    assert np.allclose(m / m[:, 2:, 2:], TRUE, atol=1e-6)


def test_closed_form_of_sets_of_four():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random((300, 4, 2)), rng.integers(0, 8, (300, 4, 2)) / [639 / 80, 359 / 45]])
    q = np.stack([R.mapped(TRUE[None], s)[0] for s in p])
    q[::5] = rng.random(q[::5].shape)  # any four targets have a map
    m, fixed = R.framed(p, q)
    other = R.solved(p, q)
    line = [min(abs(np.linalg.det(np.column_stack([np.delete(s, k, axis=0), np.ones(3)]))) for k in range(4)) < 1e-12 for s in p]
    assert (fixed == ~np.array(line)).all() and 300 < fixed.sum() < 560
    for s, t, a, b in zip(p[fixed], q[fixed], m[fixed], other[fixed], strict=True):
        assert np.allclose(R.mapped(a[None], s)[0], t, atol=1e-6) and np.allclose(a / np.linalg.norm(a) * np.sign((a * b).sum()), b, atol=1e-5)
    rows = np.concatenate([p.reshape(-1, 2), q.reshape(-1, 2)], axis=1)[:100]
    off = (R.mapped(m[fixed], rows[:, :2]) - rows[:, 2:]) * [639, 359]
    with np.errstate(invalid="ignore"):
        assert (np.abs(R.agreeing(m[fixed], rows, 639, 359) - (np.hypot(off[..., 0], off[..., 1]) <= 1).sum(axis=1)) <= 1).all()


def test_grids_and_matches_in_a_line(spark):
    x, y = (a.ravel() for a in np.meshgrid(np.arange(8) * 80.0, np.arange(8) * 45.0))
    there = R.mapped(TRUE[None], np.stack([x, y], axis=1) / [639, 359])[0] * [639, 359]
    grid = np.column_stack([x, y, there]).tolist()
    row = [[20.0 * i, 100.0, 20.0 * i + 3, 104.0] for i in range(30)]  # all in a line: still found, and too narrow
    out = run(spark, {0: grid, 1: row})
    assert out[0].reason is None and out[0].inliers == 64 and np.allclose(np.reshape(out[0].m, (3, 3)), TRUE, atol=1e-6)
    assert out[1].reason == "narrow-coverage"
