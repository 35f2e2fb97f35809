"""Stated expectations of kernels, folds and functions on small inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import backends, geometry, scalars
from cadenza.operators import aggregates, cover, grids, joins, select, sequences, settings, splat, telemetry
from cadenza.plans.aggregate_queries import components


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def row_of(spark, values):
    return spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(values)], "frame int, y int, x int, v double")


@pytest.mark.parametrize("right, expected", [(True, [1, 8, 8, 8, 7]), (False, [1, 1, 1, 8, 7])])
def test_directional_fill(spark, right, expected):
    df = spark.createDataFrame([(0, i, v, h) for i, (v, h) in enumerate(zip([1, 2, 9, 8, 7], [0, 1, 1, 0, 0], strict=True))], "k int, x int, v int, hole int")
    out = df.withColumn("f", sequences.filled(F.when(F.col("hole") == 0, F.col("v")), ["k"], "x", right))
    assert [r.f for r in out.orderBy("x").collect()] == expected


def test_candidate_offsets():
    assert joins.candidate_offsets(8) == [-1, 1, -2, 2, -4, 4, -8, 8]
    assert joins.candidate_offsets(6) == [-1, 1, -2, 2, -4, 4, -6, 6]


@pytest.mark.parametrize("kind, expected", [("half-sbs", (1920, 2160, 3840, 2160)), ("full-sbs", (3840, 2160, 7680, 2160)), ("half-ou", (3840, 1080, 3840, 2160))])
def test_layouts(spark, kind, expected):
    got = geometry.layout(F.lit(3840), F.lit(2160), F.lit(kind))
    assert tuple(spark.range(1).select(*got).first()) == expected


def test_warp_steps(spark):
    for d, symmetric, n in ((4.9, True, 1), (6.0, True, 2), (4.0, False, 2), (12.0, False, 6)):
        assert one(spark, n=geometry.warp_steps(F.lit(d), F.lit(symmetric))).n == n
    for anchor, factors in (("left", (0, -1)), ("right", (1, 0)), ("both", (0.5, -0.5))):
        assert tuple(spark.range(1).select(*geometry.shift_factors(F.lit(anchor))).first()) == factors


@pytest.mark.parametrize("w, h, mode, packing, cap, ipd, codec, expected", [(3840, 1632, "2160", "full-sbs", 0, 0, "h265", (7680, 1632, "")), (5082, 2160, "source", "full-sbs", 0, 0, "h265", (10164, 2160, "wide")), (4096, 2160, "source", "full-sbs", 0, 0, "h265", (8192, 2160, "")), (4098, 2160, "source", "full-sbs", 0, 0, "h265", (8196, 2160, "wide")), (3840, 1632, "2160", "full-sbs", 0, 10, "h265", (9984, 1632, "wide"))])
def test_geometry_plan(spark, w, h, mode, packing, cap, ipd, codec, expected):
    jobs = spark.createDataFrame([(w, h, mode, packing, codec, cap, ipd)], "w long, h long, mode string, packing string, codec string, cap long, ipd long")
    r = geometry.plan(jobs).first()
    assert (r.out_w, r.out_h, ",".join(r.errors)) == expected


def test_cap(spark):
    jobs = spark.createDataFrame([(3840, 1632, "source", "half-ou", "h265", 1024, 0)], "w long, h long, mode string, packing string, codec string, cap long, ipd long")
    r = geometry.plan(jobs).first()
    assert (r.eye_w, r.eye_h) == (1024, 436)


def test_format_time(spark):
    for seconds, text in ((59.2, "01:00"), (3599.5, "01:00:00"), (-1.0, "—"), (float("nan"), "—"), (0.0, "00:00")):
        assert one(spark, t=scalars.format_time(F.lit(seconds))).t == text
    assert one(spark, t=scalars.format_time(F.lit(None).cast("double"))).t == "—"


def test_parse_rate(spark):
    for text, rate in (("30000/1001", 30000 / 1001), ("25", 25.0), ("1/0", None), ("x", None)):
        assert one(spark, r=scalars.parse_rate(F.lit(text))).r == rate
    assert one(spark, r=scalars.parse_rate(F.lit("x"), 0.0)).r == 0.0


def test_settings(spark):
    rules = [settings.Rule("d", "number", 2.0, 0, 8), settings.Rule("n", "integer", 1, 0, 10), settings.Rule("m", "choice", "a", options=("a", "b")), settings.Rule("f", "flag", "true")]
    cases = {"d": "NaN", "n": "1.5", "m": "c", "f": "1", "z": "0"}
    made = F.create_map(*(F.lit(x) for kv in cases.items() for x in kv))
    r = one(spark, e=settings.problems(made, rules), d=settings.with_defaults(F.create_map(F.lit("d"), F.lit("3")), rules))
    assert r.e == {"d": "type", "n": "type", "m": "choice", "f": "type", "z": "unknown"}
    assert r.d == {"d": "3", "n": "1", "m": "a", "f": "true"}


def test_splat_front_layer(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 200.0), (1, 1.0, 1.0, 220.0), (1, 0.1, 5.0, 10.0), (2, 0.5, 0.001, 9.0)], "target long, layer double, weight double, colour double")
    out = {r.target: r for r in splat.splat(rows, 0.05).collect()}
    assert out[1].near == 210 and out[1].far == 10 and out[1].hits == 2 and out[1].valid
    assert not out[2].valid


def test_taps(spark):
    r = one(spark, t=splat.taps(F.lit(2.25)), whole=splat.taps(F.lit(3.0)))
    assert [(t.target, t.weight) for t in r.t] == [(2, 0.75), (3, 0.25)]
    assert [t.target for t in r.whole] == [3]


def test_flow_composition_keeps_least_confidence(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0.8), (0, 1, 1.0, 0.7)], "session int, frame int, dx double, c double")
    w = sequences.ordered("session").rowsBetween(0, 1)
    r = df.select("frame", F.sum("dx").over(w).alias("dx"), F.min("c").over(w).alias("c")).where("frame = 0").first()
    assert (r.dx, r.c) == (2.0, 0.7)


def test_box_mean_of_constant(spark):
    df = spark.createDataFrame([(0, y, x, 3.5) for y in range(6) for x in range(5)], "frame int, y int, x int, v double")
    assert {r.m for r in grids.box(df, F.col("v"), 2, "m").collect()} == {3.5}
    assert {round(r.s, 12) for r in grids.bilinear(df, F.lit(1.5), F.lit(2.5), "s").collect()} == {3.5}


def test_push_pull(spark):
    out = grids.push_pull(row_of(spark, [4.0, -1.0, -1.0, -1.0, 8.0]), F.col("v") > 0, (1, 2)).orderBy("x").collect()
    assert [r.f for r in out] == [4.0, 4.0, 6.0, 8.0, 8.0]


@pytest.mark.parametrize("seed", range(5))
def test_components_against_flood(seed):
    mask = np.random.default_rng(seed).random((9, 11)) > 0.6
    seen, groups = set(), []
    for start in zip(*np.nonzero(mask), strict=True):
        if start in seen:
            continue
        stack, group = [start], set()
        while stack:
            y, x = stack.pop()
            if (y, x) in group or not (0 <= y < 9 and 0 <= x < 11 and mask[y, x]):
                continue
            group.add((y, x))
            stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= group
        groups.append(group)
    found = [set(zip(ys.tolist(), xs.tolist(), strict=True)) for ys, xs in components(mask)]
    assert sorted(map(sorted, found)) == sorted(sorted((int(y), int(x)) for y, x in g) for g in groups)


@pytest.mark.parametrize("seed", range(5))
def test_tiles_own_every_cell_once(seed):
    mask = np.random.default_rng(seed).random((12, 20)) > 0.8
    owned = np.zeros(mask.shape, int)
    for x0, y0, x1, y1, *_ in select.tiles(mask, 4, 2, 0, 1):
        owned[y0:y1, x0:x1] += 1
    assert owned.max() <= 1 and (owned[mask] == 1).all()
    assert select.tiles(np.zeros((8, 8), bool), 4, 2, 1, 1) == []
    tall = np.zeros((20, 9), bool)
    tall[:, 4] = True
    assert select.tiles(tall, 4, 3, 0, 4) == [(4, 0, 8, 12, 0, 0, 9, 16), (4, 12, 8, 20, 0, 8, 9, 20)]  # three high, then the rest; halo to fours


def test_greedy_cover_and_boxes():
    mask = np.zeros((8, 8), bool)
    mask[0:2, 0:2] = mask[5:8, 5:8] = True
    assert cover.greedy_cover(mask, 3) == [(5, 5, 9), (0, 0, 4)]
    assert select.merged_boxes([(0, 0, 1, 1), (2, 0, 3, 1), (7, 7, 8, 8)], 2, 8, 8) == [(0, 0, 3, 1), (7, 7, 8, 8)]


def test_prefetch():
    state, made = (), None
    for action, index, hit, discarded in (("schedule", 0, None, 0), ("schedule", 8, None, 0), ("take", 0, True, 0), ("take", 4, False, 1)):
        state, made = telemetry.prefetch_step(state, {"action": action, "index": index})
        assert (made["hit"], made["discarded"]) == (hit, discarded)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 11, 12, 13, 18, 31])
def test_chunk_plan_covers_every_frame(spark, n):
    chunks = one(spark, c=sequences.chunk_plan(F.lit(n), 6, 2)).c
    assert [i for c in chunks for i in range(c.first, c.end)] == list(range(n))


@pytest.mark.parametrize("n", [1, 5, 6, 7, 13, 40])
def test_windows_own_each_frame_once(spark, n):
    """Twelve frames are seen, of which six are owned; what is seen is clamped to the scene."""
    rows = sequences.owned_windows(spark.range(100, 100 + n).selectExpr("0 as k", "id as frame"), ["k"]).collect()
    owned = sorted(r.frame for r in rows if 3 <= r.order < 3 + r.outputs)
    assert owned == list(range(100, 100 + n)) and len(rows) == 12 * -(-n // 6)
    for r in rows:
        assert r.frame == min(max(100, r.start + r.order - 3), 99 + n) and r.first_donor == max(100, r.start - 6) and r.last_donor == min(99 + n, r.start + 11)


def test_refresh_at_start_and_cut(spark):
    rows = [(0, i, i == 5, 0.9, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "session int, frame int, cut boolean, confidence double, motion double")
    out = sequences.refresh_schedule(df, 4, 2, 0.1, 90).orderBy("frame").collect()
    assert [r.frame for r in out if r.refresh] == [0, 4, 5, 9]


def test_combined_rate(spark):
    rate = lambda s, o: one(spark, r=aggregates.combined_rate([F.lit(x) for x in s], [F.lit(x) for x in o])).r
    assert rate([], [10.0, 20.0]) == 10 and rate([], [0.0, 20.0]) == 20 and rate([10.0], [10.0, 20.0]) == 5 and rate([0.0], [10.0]) == 0


def test_backends(spark):
    df = spark.createDataFrame([([0.0, 0.5, 2.0],)], "v array<float>")
    assert np.allclose(df.select(backends.applied(F.col("v"), "auto", ["nothing", "clip"]).alias("o")).first().o, [0.02, 0.5, 0.98])
    with pytest.raises(NotImplementedError):
        backends.create("depth-model")
    with pytest.raises(RuntimeError):
        backends.create("auto", ["nothing"])


def test_boxes_merge_by_shares_of_the_grid():
    """On a wide grid two boxes five columns apart are nearer than two that are two rows apart."""
    assert select.merged_boxes([(0, 0, 1, 1), (5, 0, 6, 1), (0, 2, 1, 3)], 2, 100, 4) == [(0, 0, 6, 1), (0, 2, 1, 3)]


def test_any_grid_and_none(spark):
    assert select.grid_of(None).shape == (0, 0) and select.grid_of([1.0, None, 3.0]).shape == (2, 2)
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, 1.0]), (4, [1.0] * 25)], "vec_id long, embedding array<float>")
    found = select.per_grid(df, lambda g: [(len(g), int((g > 0.5).sum()))], "frame long, side int, cells int", ["frame", "side", "cells"], [pa.int64(), pa.int32(), pa.int32()])
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0), (2, 0, 0), (3, 2, 2), (4, 5, 25)]
    for make in (lambda g: cover.greedy_cover(g > 0.5, 3), lambda g: select.tiles(g > 0.5, 2, 1, 1, 2)):
        assert make(select.grid_of(None)) == []


def test_nearest_value_on_either_side(spark):
    from cadenza.operators import joins

    rng = np.random.default_rng(3)
    values = [(float(v), int(i)) for i, v in enumerate(np.round(rng.normal(0, 1000, 50), 2))]
    probes = [(i, float(v)) for i, v in enumerate(np.round(rng.normal(0, 3000, 200), 2))] + [(900, values[3][0]), (901, -1e9), (902, 1e9)]
    out = joins.nearest(spark.createDataFrame(probes, "id long, at double"), spark.createDataFrame(values, "at double, source int"), "at", "source").collect()
    expected = {i: min((abs(v - p), s) for v, s in values) for i, p in probes}
    assert {r.id: (r.distance, r.source) for r in out} == expected


def test_two_nearest_codes(spark):
    from cadenza.operators import joins

    rng = np.random.default_rng(4)
    codes = [(int(i), int(c)) for i, c in enumerate(rng.integers(-(2**62), 2**62, 300))] + [(400, None)]
    df = spark.createDataFrame(codes, "id long, code long")
    for r in joins.nearest_two(df.where("id % 20 = 0"), df, 0.72, query_rows=4, rows=32).collect():
        mine = dict(codes)[r.id]
        best = sorted((bin((mine ^ c) % 2**64).count("1"), i) for i, c in codes if i != r.id and c is not None)
        assert (r.distance, r.match, r.second) == (*best[0], best[1][0])


def test_lag_in_stretches(spark):
    from cadenza.operators import sequences

    rows = [(k, i, f"{k}{i}") for k in ("a", None) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "key string, frame long, v string")
    out = {(r.key, r.frame): r.was for r in sequences.lagged(df, ["key"], "frame", "v", "was", span=7).collect()}
    assert len(out) == len(rows) and all(out[k, i] == (f"{k}{i - 3}" if i else None) for k, i, _ in rows)


def test_closed_masks_and_starts():
    mask = np.zeros((9, 9), bool)
    mask[4, 3] = mask[4, 5] = True
    assert np.argwhere(select.closed(mask, 1)).tolist() == [[4, 3], [4, 4], [4, 5]]
    assert select.closed(np.ones((4, 4), bool), 1).all() and not select.closed(np.zeros((4, 4), bool), 2).any()
    assert select.closed(select.grid_of(None) > 0, 1).shape == (0, 0)


def test_starts_along_an_axis(spark):
    of = lambda low, high, side, stride, size: one(spark, s=cover.axis_starts(F.lit(low), F.lit(high), F.lit(side), side - stride, F.lit(size))).s
    assert of(2, 5, 5, 3, 20) == [1] and of(0, 10, 4, 3, 10) == [0, 3, 6] and of(3, 14, 4, 3, 14) == [3, 6, 9, 10] and of(0, 3, 9, 2, 9) == [0]


RULES = {"overlap": 8, "context": 1.25, "least": 4, "most": 9, "snap": 4, "smallest": 8}


def covered(spark, mask, side, **options):
    """The mask's squares in order, and all candidates."""
    rules = RULES | options
    grids_ = spark.createDataFrame([(0, mask.ravel().astype(float).tolist())], "frame long, v array<double>")
    found = cover.masks(grids_, lambda v: np.array(v, bool).reshape(mask.shape), components, rules["least"])
    places = found.select(cover.candidates(F.col("parts"), F.col("height"), F.col("width"), side, rules["overlap"], rules["context"], rules["snap"], rules["smallest"]).alias("c")).first().c
    return [tuple(r[2:]) for r in sorted(cover.roi_cover(found, side, **rules).collect(), key=lambda r: r["rank"])], [tuple(c) for c in places or []]


def plain_cover(mask, places, share, most, least):
    """Counts every square anew for every choice."""
    wanted = np.zeros_like(mask)
    for ys, xs in components(mask):
        if len(ys) >= least:
            wanted[ys, xs] = True
    places = [(x, y, s) for x, y, s, tile in places if not tile or mask[y : y + s, x : x + s].sum() >= least]
    left, out = wanted.copy(), []
    while places and wanted.sum() - left.sum() < max(least, np.ceil(share * wanted.sum())) and len(out) < most:
        gains = [int(left[y : y + s, x : x + s].sum()) for x, y, s in places]
        if max(gains) < least:
            break
        x, y, s = places[gains.index(max(gains))]
        left[y : y + s, x : x + s] = False
        out.append((x, y, s, max(gains)))
    return out


def test_roi_cover(spark):
    mask = np.zeros((64, 64), bool)
    mask[10:16, 10:14] = True  # 6 x 4: a square of 8 about it
    mask[50, 50] = True  # too small: left alone
    assert covered(spark, mask, 32)[0] == [(8, 8, 8, 24)]
    mask[10:16, 20:24] = True  # a second part: one larger square has both
    assert [(s, gain) for _, _, s, gain in covered(spark, mask, 32)[0]] == [(32, 48)]
    long = np.zeros((16, 64), bool)
    long[7:9, :] = True  # longer than a square: squares along it, each cell once
    found, _ = covered(spark, long, 16)
    assert sum(gain for *_, gain in found) >= 0.985 * 128 and all(s == 16 for _, _, s, _ in found)
    assert len(covered(spark, long, 16, most=2)[0]) == 2 and covered(spark, np.zeros((8, 8), bool), 4)[0] == []


@pytest.mark.parametrize("seed", range(6))
def test_roi_cover_equals_plain_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    mask = select.closed(rng.random((rng.integers(20, 60), rng.integers(20, 60))) > 0.95, 1)
    for side, options in ((16, {"overlap": 4, "least": 3}), (9, {"overlap": 2, "least": 2, "snap": 1, "smallest": 3, "most": 30})):
        found, places = covered(spark, mask, side, **options)
        rules = RULES | options
        assert found == plain_cover(mask, places, 0.985, rules["most"], rules["least"]) and found


@pytest.mark.parametrize("seed", range(3))
def test_lazy_cover_equals_plain_greedy(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((15, 20)) > 0.7
    squares = rng.integers(0, 14, (60, 3)) + [0, 0, 1]
    assert cover.lazy_cover(mask, squares, 0.9, 12, 1) == plain_cover(mask, [(*map(int, q), False) for q in squares], 0.9, 12, 1)


def grid_rows(spark, grid):
    return spark.createDataFrame([(0, y, x, float(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], "frame int, y int, x int, v double")


def test_blurred(spark):
    out = {(r.y, r.x): r.b for r in grids.blurred(grid_rows(spark, np.full((4, 5), 3.0)), F.col("v"), 2, 1.0, "b").collect()}
    assert np.allclose(list(out.values()), 3)
    point = np.zeros((5, 5))
    point[2, 2] = 1
    out = {(r.y, r.x): r.b for r in grids.blurred(grid_rows(spark, point), F.col("v"), 1, 0.8, "b").collect()}
    side = np.exp(-1 / 1.28)
    assert np.isclose(out[2, 2], 1 / (1 + 2 * side) ** 2) and np.isclose(out[1, 2], side * out[2, 2]) and out[0, 2] == 0


def test_seam_score(spark):
    grid = np.tile([9.0, 9.0, 9.0, 5.0, 5.0, 5.0], (4, 1))
    score = lambda hole: grids.seam_score(grid_rows(spark, grid), hole).first().score
    assert np.isclose(score(F.col("x").between(1, 2)), 4 + 0.55 * 4)  # the run ends where values jump
    assert score(F.col("x") == 0) == 0 and score(F.col("x") >= 4) is None and score(F.lit(False)) is None


def test_photo_valid_and_repair(spark):
    depth = np.where(np.arange(6) < 4, 0.2, 0.9)[None].repeat(6, axis=0)
    d = grid_rows(spark, depth).withColumn("t", F.lit(0.5)).withColumn("o", F.when(F.col("y") < 3, 0.5).otherwise(0.7))
    ok = {(r.y, r.x): r.ok for r in grids.photo_valid(d, "t", "o", 1, most=0.055).collect()}
    assert ok[1, 1] and not ok[4, 1]  # alike above, not below
    assert not ok[1, 5]  # too little is far there

    donors = spark.createDataFrame([(0, n, y, x, 10.0 * n + x, 0.2 if n < 3 else 0.9) for n in (1, 2, 3) for y in range(4) for x in range(4)], "frame int, donor int, y int, x int, v double, depth double")
    ask = lambda y, x, n, px, ok=True, sure=0.9: (0, y, x, n, 0.2, ok, sure, px, 1.0)
    rows = [ask(0, 0, 1, 5.0), ask(0, 0, 2, 1.5), ask(0, 1, 1, 1.0), ask(0, 1, 2, 1.0), ask(0, 2, 3, 1.0), ask(0, 3, 1, 1.0, False), ask(1, 0, 1, 1.0, True, 0.6)]
    points = spark.createDataFrame(rows, "frame int, y int, x int, donor int, far double, ok boolean, confidence double, px double, py double")
    out = {(r.y, r.x): (r.donor, r.value) for r in grids.repaired(points, donors, 4, 4).collect()}
    assert out == {(0, 0): (2, 21.5), (0, 1): (1, 11.0), (0, 2): (None, None), (0, 3): (None, None), (1, 0): (None, None)}


@pytest.mark.parametrize("shares", [grids.linear, grids.cubic])
def test_sampling_keeps_a_plane(spark, shares):
    """Inside the grid both curves reproduce a plane; on cells they give the cells, and the border goes on outside."""
    source = grid_rows(spark, np.add.outer(3 * np.arange(6.0), np.arange(6.0)))
    at = [(2.25, 2.5), (3.0, 2.0), (9.0, 5.0), (-4.0, 0.0)]
    points = spark.createDataFrame([(0, 0, i, *p) for i, p in enumerate(at)], "frame int, y int, x int, px double, py double")
    out = {r.x: r.s for r in grids.sampled(points, source, 6, 6, "s", shares).collect()}
    assert np.allclose([out[i] for i in range(4)], [9.75, 9, 20, 0])


def test_backward_view_keeps_the_front(spark):
    """A block nearer by two cells moves by them; outside the bands its colour comes whole, and a flat grid stays flat."""
    cells = [(f, y, x, (0.5 if 2 <= x <= 4 else 0.0) if f else 0.25) for f in (0, 1) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(cells, "frame long, y int, x int, v double")
    out = grids.backward_view(grids.visible(df, F.col("v") * 4, 6, 8), 8, 8, 4.0).collect()
    assert len(out) == 128 and {r.view for r in out if r.frame == 0 and not r.compose} == {0.25}
    plain = [r for r in out if r.frame == 1 and not r.compose]
    assert all(r.view == (0.5 if 4 <= r.x <= 6 else 0.0) for r in plain) and any(r.view for r in plain)
    assert any(r.compose for r in out if r.frame == 1)
