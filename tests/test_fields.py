"""Flow, recurring grids and soft masks on stated cases."""

import numpy as np
import pytest

from cadenza.operators import fields as V

SIZE = 24  # cells of a 4 x 6 grid


def full(v, n=SIZE):
    return [float(v)] * n


def edges(spark, rows):
    return spark.createDataFrame(rows, "scene long, frame long, dx array<double>, dy array<double>, confidence array<double>")


def test_sample_against_plain_numbers():
    rng = np.random.default_rng(2)
    values, x, y = rng.normal(size=(3, 4, 6)), rng.uniform(-3, 8, (3, 4, 6)), rng.uniform(-3, 6, (3, 4, 6))
    for edge in ("nearest", "zero"):
        got = V.sample(values, x, y, edge)
        for at in np.ndindex(3, 4, 6):
            px, py = (min(max(x[at], 0), 5), min(max(y[at], 0), 3)) if edge == "nearest" else (x[at], y[at])
            total = 0.0
            for cy in range(4):
                for cx in range(6):
                    total += values[at[0], cy, cx] * max(0, 1 - abs(px - cx)) * max(0, 1 - abs(py - cy))
            assert got[at] == pytest.approx(total)


def test_chained_flow_adds_adjacent_motion(spark):
    """Two hops of one cell each, the lesser confidence; backwards; a missing edge leaves no confidence but the way so far."""
    rows = [(0, i, full(1), full(0), full(0.8 - 0.1 * i)) for i in (0, 1)] + [(0, 2, None, None, None), (1, 0, full(1), full(0), full(0.5))]
    out = {(r.scene, r.frame): r for r in V.chained(edges(spark, rows), 2, 4, 6).collect()}
    assert set(out) == {(0, 0), (0, 1), (0, 2), (1, 0)}
    at = 1 * 6 + 1
    assert out[0, 0].dx[at] == pytest.approx(2) and out[0, 0].confidence[at] == pytest.approx(0.7)
    assert out[0, 0].dx[5] == pytest.approx(1)  # the second edge is sampled beyond the grid
    assert out[0, 1].dx[at] == pytest.approx(1) and out[0, 1].confidence == full(0) == out[0, 2].confidence == out[1, 0].confidence
    back = [(0, 0, None, None, None), (0, 1, full(-1), full(0), full(0.9)), (0, 2, full(-1), full(0.5), full(0.6))]
    r = {r.frame: r for r in V.chained(edges(spark, back), 2, 4, 6, back=True).collect()}[2]
    assert r.dx[3] == pytest.approx(-2) and r.dy[3] == pytest.approx(0.5) and r.confidence[3] == pytest.approx(0.6)
    assert V.chained(edges(spark, []), 2, 4, 6).count() == 0


def pair(spark, dx, back_dx, first=100, second=100, own=0.25, other=0.25, n=64):
    row = (full(first, n), full(second, n), full(dx, n), full(0, n), full(back_dx, n), full(0, n), full(own, n), full(other, n))
    return spark.createDataFrame([row], ", ".join(f"{c} array<double>" for c in [*V.FLOWS, "first_depth", "second_depth"]))


def test_a_flow_that_does_not_come_back_is_not_trusted(spark):
    good = V.reliability(pair(spark, 0, 0).drop("first_depth", "second_depth"), 8, 8).first().confidence
    bad = V.reliability(pair(spark, 0, 5).drop("first_depth", "second_depth"), 8, 8).first().confidence
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.01
    gone = V.reliability(pair(spark, 3, -3).drop("first_depth", "second_depth"), 8, 8).first().confidence
    assert np.reshape(gone, (8, 8))[:, 5:].max() == 0 and np.reshape(gone, (8, 8))[:, :5].min() > 0.99


@pytest.mark.parametrize(("change", "valid"), [({}, 49), ({"back_dx": 0.8}, 0), ({"second": 113}, 0), ({"other": 0.32}, 0), ({"dx": 2, "back_dx": -2}, 35), ({"back_dx": 0.7}, 49)])
def test_links_need_round_trip_image_and_depth(spark, change, valid):
    r = V.validated(pair(spark, **({"dx": 0, "back_dx": 0} | change)), 8, 8).first()
    assert sum(r.valid) == valid and r.u[0] == pytest.approx(change.get("dx", 0) / 7)


MOTION = "scene long, frame long, depth array<double>, dx array<double>, dy array<double>, confidence array<double>, valid array<boolean>"


def test_motion_keeps_confident_history(spark):
    rows = [(0, 0, full(1, 80), full(0, 80), full(0, 80), full(255, 80), [True] * 80), (0, 1, full(0, 80), full(0, 80), full(0, 80), full(255, 80), [True] * 80), (0, 2, full(0, 80), None, None, None, None), (1, 0, full(0.5, 80), None, None, None, None)]
    step = V.compensated(0.75, (8, 10), (8, 10), (8, 10))
    out = {(r.scene, r.frame): np.mean(r.out) for r in V.grid_fold(spark.createDataFrame(rows, MOTION), ["scene"], "frame", step, "out array<double>", ["scene", "frame"]).collect()}
    assert out == pytest.approx({(0, 0): 1, (0, 1): 0.75, (0, 2): 0.5625, (1, 0): 0.5})
    untrusted = V.compensated(0.75, (8, 10), (8, 10), (8, 10))(np.ones((8, 10)), {"depth": np.zeros(80), "dx": np.zeros(80), "dy": np.zeros(80), "confidence": np.full(80, 255.0), "valid": np.zeros(80)})
    assert untrusted[0].max() == 0


def reuse(refresh, at):
    seed, hole = np.full((32, 32), 120.0), np.zeros((32, 32), bool)
    previous = seed.copy()
    seed[8:24, 8:24], hole[8:24, 8:24] = 0, True
    row = {"seed": seed.ravel(), "hole": hole.ravel(), "dx": np.zeros(1024), "dy": np.zeros(1024), "confidence": np.ones(1024), "at": at}
    return V.reused(0.4, 1.0, 0.1, (32, 32), refresh)((previous, hole), row)[1], hole.ravel()


def test_history_repairs_holes_and_refresh_keeps_it_as_a_seed():
    made, hole = reuse(8, 3)
    assert made["reused"] == 256 and not made["residual"].any() and (made["out"] == 120).all() and made["photometric"] < 0.01
    made, hole = reuse(8, 16)
    assert made["reused"] == 0 and (made["residual"] == hole).all() and (made["out"] == 120).all()


def test_inward_feather_stays_inside():
    mask = np.zeros((1, 21, 21), bool)
    mask[0, 4:17, 8:13] = True
    alpha = V.inward_feather(mask, 3.0)[0]
    assert (alpha[~mask[0]] == 0).all() and alpha[10, 10] > 0.9 and 0 < alpha[4, 8] < 0.5
    rng = np.random.default_rng(4)
    some = rng.random((5, 7, 9)) < 0.8
    d = V.inward_distance(some)
    for n, y, x in np.ndindex(some.shape):
        ways = [V.STRAIGHT * abs(abs(y - b) - abs(x - a)) + V.DIAGONAL * min(abs(y - b), abs(x - a)) for b, a in zip(*np.nonzero(~some[n]), strict=True)]
        assert d[n, y, x] == pytest.approx(min(ways, default=np.inf))
    assert (V.inward_feather(np.ones((1, 3, 3), bool), 2.0) == 1).all() and (V.inward_feather(mask, 0) == mask).all()


def test_pyramid_fills_an_odd_grid(spark):
    rows = [(0, y, x, 5.0 if (y, x) == (0, 0) else 9.0 if (y, x) == (4, 6) else None) for y in range(5) for x in range(7)] + [(1, 0, 0, None)]
    out = {(r.frame, r.y, r.x): r.f for r in V.pyramid_fill(spark.createDataFrame(rows, "frame long, y int, x int, v double"), "v", "f", 3).collect()}
    assert out[0, 1, 1] == 5 and out[0, 3, 3] == 5 and out[0, 4, 5] == 9 and out[0, 2, 5] == 7 and out[1, 0, 0] is None
    plan = V.pyramid_fill(spark.createDataFrame(rows, "frame long, y int, x int, v double"), "v", "f", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1


def _grid_table(spark, folder):
    rows = [(i, [((i * 31 + c * 17) % 41 - 20) / 31 for c in range(64)]) for i in range(6)]
    rows[1][1][5] = None
    rows[2] = (2, rows[2][1][:20])  # a grid that ends early
    rows += [(3, [c / 67 for c in range(64)]), (7, None), (8, [])]  # a frame that comes twice, and no grids
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "int(0) as label").write.parquet(f"{folder}/embeddings.parquet")
    return rows


@pytest.mark.parametrize("name", ["expanded_input", "motion_patch", "resized_flow"])
def test_fixed_places_need_no_join(spark, tmp_path, name):
    """Cells exploded and joined were underrated by the planner and broadcast, which took the driver's memory."""
    import oracle

    from cadenza import catalog

    _grid_table(spark, tmp_path)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    c = oracle.connection.__globals__["duckdb"].connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    made = c.sql(catalog.ORACLES[name])
    assert oracle.rows(df.columns, [tuple(r) for r in df.collect()]) == oracle.rows(made.columns, made.fetchall())


@pytest.mark.parametrize("name", ["warped_history", "inverse_view", "between_frames"])
def test_sampled_cells_are_never_broadcast(spark, sf_dir, name):
    from cadenza import catalog

    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [frame#" in plan and "BroadcastHashJoin [frame#" not in plan
