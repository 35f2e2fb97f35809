"""Kernels on 8 x 8 or any grids in long form: a row per cell, windows along rows and columns.

A box mean over k x k cells is a mean along rows of means along columns with counts, so it is two windows. What needs
sampling between cells joins the four cells about a point.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .splat import splat, taps


def by_frame(df: DataFrame) -> DataFrame:
    """The cells dealt by frame: windows along rows and along columns of it then need no other shuffle, however often they alternate."""
    return df.repartition("frame")


def along(axis: str, radius: int):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("frame", other).orderBy(axis).rowsBetween(-radius, radius)


def box(df: DataFrame, value: Column, radius: int, name: str) -> DataFrame:
    """Mean over the (2 radius + 1)² box about each cell, cut to the grid."""
    rows = df.withColumn("_s", F.sum(value).over(along("x", radius))).withColumn("_n", F.count(value).over(along("x", radius)))
    return rows.withColumn(name, F.sum("_s").over(along("y", radius)) / F.sum("_n").over(along("y", radius))).drop("_s", "_n")


def extreme(df: DataFrame, value: Column, radius: int, name: str, largest: bool) -> DataFrame:
    """Greatest or least value of the box about each cell."""
    f = F.max if largest else F.min
    return df.withColumn("_s", f(value).over(along("x", radius))).withColumn(name, f("_s").over(along("y", radius))).drop("_s")


def normalised(df: DataFrame) -> DataFrame:
    """.02 + .96 * x ** .8 of values between their .02 and .98 quantiles; .5 where those are alike."""
    q = df.groupBy("frame").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    span = F.col("q")[1] - F.col("q")[0]
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("q")[0]) / F.nullif(span, F.lit(0.0))))
    return df.join(q, "frame").withColumn("d", F.when(span < 1e-6, 0.5).otherwise(0.02 + 0.96 * F.pow(x, F.lit(0.8)))).drop("q")


def guided(df: DataFrame, guide: Column, value: Column, radius: int = 2, eps: float = 0.0025, keep: float = 0.35) -> DataFrame:
    """Guided filter: local linear fits of value on guide, their means applied, mixed with the value."""
    d = by_frame(df).withColumn("_i", guide).withColumn("_p", value)
    for name, c in (("_mi", F.col("_i")), ("_mp", F.col("_p")), ("_ii", F.col("_i") * F.col("_i")), ("_ip", F.col("_i") * F.col("_p"))):
        d = box(d, c, radius, name)
    a = (F.col("_ip") - F.col("_mi") * F.col("_mp")) / (F.col("_ii") - F.col("_mi") * F.col("_mi") + eps)
    d = d.withColumn("_a", a).withColumn("_b", F.col("_mp") - F.col("_a") * F.col("_mi"))
    d = box(box(d, F.col("_a"), radius, "_ma"), F.col("_b"), radius, "_mb")
    out = keep * F.col("_p") + (1 - keep) * (F.col("_ma") * F.col("_i") + F.col("_mb"))
    return d.withColumn("d", F.greatest(F.lit(0.02), F.least(F.lit(0.98), out))).select(*df.columns, "d")


def push_pull(df: DataFrame, known: Column, radii: tuple[int, ...]) -> DataFrame:
    """Holes take the mean of known cells in the row, in ever wider reach; what is filled stays."""
    d = df.withColumn("f", F.when(known, F.col("v")))
    for r in radii:
        d = d.withColumn("f", F.coalesce("f", F.avg("f").over(along("x", r))))
    return d


def shifted(df: DataFrame, dx: int, dy: int, name: str) -> DataFrame:
    """The value of the cell at (x + dx, y + dy), the border repeated."""
    at = df.groupBy("frame").agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    clip = lambda c, d, top: F.greatest(F.lit(0), F.least(F.col(top), F.col(c) + d)).cast("int")
    source = df.select("frame", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias(name))
    wide = df.join(at, "frame").withColumn("_x", clip("x", dx, "_w")).withColumn("_y", clip("y", dy, "_h"))
    return wide.join(source, ["frame", "_x", "_y"]).drop("_x", "_y", "_w", "_h")


def bilinear(df: DataFrame, px: Column, py: Column, name: str) -> DataFrame:
    """The value between the four cells about (px, py), by weight; cells outside the grid count as zero."""
    d = df.withColumn("_px", px).withColumn("_py", py).withColumn("_x0", F.floor("_px").cast("int")).withColumn("_y0", F.floor("_py").cast("int"))
    taps = []
    for oy in (0, 1):
        for ox in (0, 1):
            wx = (F.col("_px") - F.col("_x0")) if ox else 1 - (F.col("_px") - F.col("_x0"))
            wy = (F.col("_py") - F.col("_y0")) if oy else 1 - (F.col("_py") - F.col("_y0"))
            taps.append(F.struct((F.col("_x0") + ox).alias("x"), (F.col("_y0") + oy).alias("y"), (wx * wy).alias("w")))
    t = d.select("frame", "y", "x", F.explode(F.array(*taps)).alias("t")).select("frame", F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), "t.w")
    hit = t.join(df.select("frame", "y", "x", "v"), ["frame", "y", "x"], "left")
    return hit.groupBy("frame", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * F.col("w")).alias(name))


def pooled(df: DataFrame, value: Column, ry: int, rx: int, name: str, largest: bool = False) -> DataFrame:
    """Sum or greatest value of the (2 ry + 1) x (2 rx + 1) box about each cell; cells outside the grid count as zero."""
    f = F.max if largest else F.sum
    return df.withColumn("_s", f(value).over(along("x", rx))).withColumn(name, f("_s").over(along("y", ry))).drop("_s")


def linear(t):
    """Steps to the cells about a place t (a column or a number) beyond one, and their shares."""
    return [(0, 1 - t), (1, t)]


def cubic(t):
    """The same for the Catmull-Rom curve through four cells."""
    return [(-1, t * (t * (1 - 0.5 * t) - 0.5)), (0, 1 + t * t * (1.5 * t - 2.5)), (1, t * (0.5 + t * (2 - 1.5 * t))), (2, t * t * (0.5 * t - 0.5))]


def sampled(points: DataFrame, source: DataFrame, width: int, height: int, name: str | dict[str, str], shares: Callable[[Column], list[tuple[int, Column]]] = linear) -> DataFrame:
    """(frame, y, x) of `points` (frame, y, x, px, py) with the value of `source` (frame, y, x, v) at (px, py), between the cells about it by their `shares`; the border goes on outside.

    `name` is the result's, or a dict from columns of `source` to those of their results. Cells come of exploded rows, whose
    size Spark underrates by far, so neither they nor the result are ever broadcast.
    """
    names = {"v": name} if isinstance(name, str) else name
    at = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col(c)))
    d = points.select("frame", "y", "x", at("px", width - 1).alias("_px"), at("py", height - 1).alias("_py"))
    cell = lambda c, step, most: F.greatest(F.lit(0), F.least(F.floor(c) + step, F.lit(most))).cast("int")
    taps = [
        F.struct(cell("_px", ox, width - 1).alias("x"), cell("_py", oy, height - 1).alias("y"), (wx * wy).alias("w"))
        for oy, wy in shares(F.col("_py") - F.floor("_py"))
        for ox, wx in shares(F.col("_px") - F.floor("_px"))
    ]
    t = d.select("frame", F.col("y").alias("_ty"), F.col("x").alias("_tx"), F.explode(F.array(*taps)).alias("t")).select("frame", "_ty", "_tx", "t.x", "t.y", "t.w")
    hit = t.hint("merge").join(source.select("frame", "y", "x", *names), ["frame", "y", "x"])
    return hit.groupBy("frame", F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(*(F.sum(F.col(c) * F.col("w")).alias(n) for c, n in names.items())).hint("merge")


def visible(df: DataFrame, shift: Column, layers: int, width: int, tolerance: float = 0.05) -> DataFrame:
    """`df` (frame, y, x, v) with what a forward splat of its rows by `shift` leaves on each cell: near, valid (false: a hole) and crossed (more than one layer)."""
    layer = F.rint(F.col("v") * (layers - 1)) / (layers - 1)
    rows = df.select("frame", "y", layer.alias("layer"), F.col("v").alias("colour"), F.explode(taps(F.col("x") + shift)).alias("t"))
    rows = rows.select(F.struct("frame", "y", F.col("t.target").cast("int").alias("x")).alias("target"), "layer", "colour", F.col("t.weight").alias("weight"))
    seen = splat(rows.where(F.col("target.x").between(0, width - 1)), tolerance)
    lit = seen.select("target.frame", "target.y", "target.x", "near", "valid", (F.col("far_layer") < F.col("front") - tolerance).alias("crossed"))
    joined = df.join(lit, ["frame", "y", "x"], "left")
    return joined.withColumns({"valid": F.coalesce("valid", F.lit(False)), "crossed": F.coalesce("crossed", F.lit(False))})


def visibility_masks(df: DataFrame) -> DataFrame:
    """`df` (hole, crossed as booleans) with context and compose: smooth bands about dense holes; what is crossed is context only."""
    d = pooled(by_frame(df), F.col("hole").cast("int"), 1, 1, "_n")
    d = pooled(d, (F.col("_n") / 9 >= 0.22).cast("int"), 2, 1, "_d", True)
    d = pooled(d, F.col("_d"), 2, 1, "_j").withColumn("_j", (F.col("_j") / 15 >= 0.52).cast("int"))
    d = pooled(pooled(d, F.col("_j"), 2, 4, "_c", True), F.col("_j"), 3, 3, "_w", True)
    d = d.withColumn("context", (F.col("_c") > 0) | (F.col("crossed") & (F.col("_w") > 0)))
    return d.withColumn("compose", (F.col("_j") > 0) & F.col("context")).drop("_n", "_d", "_j", "_c", "_w")


def backward_view(seen: DataFrame, width: int, height: int, by: float, margin: int = 2, mix: float = 0.15, sharpen: float = 0.5, least: float = -1.0, most: float = 1.0) -> DataFrame:
    """(frame, y, x, view, compose): visibility from a forward splat by `by` * v (`visible`), colour by sampling back.

    A cell samples at its own splatted disparity, an uncovered one at that of the covered cell to its left, or else to its
    right, or 0 in a row without any. In the bands to compose, uncovered cells mirror what lies beyond that neighbour and
    a margin; there a share of the column's mean is mixed in, and edges are sharpened.
    """
    d = visibility_masks(seen.withColumn("hole", ~F.col("valid")))
    w = Window.partitionBy("frame", "y").orderBy("x")
    left, right = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    nearest = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(left), F.first(c, ignorenulls=True).over(right))
    disparity = by * F.coalesce(nearest(F.when(F.col("valid"), F.col("near"))), F.lit(0.0))
    edge = F.coalesce(nearest(F.when(F.col("valid"), F.col("x"))), F.col("x"))
    d = d.withColumns({"px": F.col("x") - disparity, "py": F.col("y"), "_edge": edge})
    d = by_frame(d.join(sampled(d, d, width, height, "_back"), ["frame", "y", "x"]))
    source = F.col("_edge") - margin - F.greatest(F.lit(0), F.col("x") - F.col("_edge") - 1)
    row = F.collect_list("_back").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mirrored = F.get(row, F.greatest(F.lit(0), F.least(F.lit(width - 1), source)))
    d = d.withColumn("view", F.when(F.col("compose") & ~F.col("valid"), mirrored).otherwise(F.col("_back")))
    d = pooled(d, F.col("view"), 2, 0, "_column")
    d = d.withColumn("view", F.when(F.col("compose"), F.col("view") + (F.col("_column") / 5 - F.col("view")) * mix).otherwise(F.col("view")))
    d = pooled(d, F.col("view"), 1, 1, "_box")
    sharp = F.col("view") + (F.col("view") - F.col("_box") / 9) * (0.35 * sharpen)
    return d.select("frame", "y", "x", F.when(F.col("compose"), F.greatest(F.lit(least), F.least(F.lit(most), sharp))).otherwise(F.col("view")).alias("view"), "compose")


def plated_view(df: DataFrame, by: float, layers: int, width: int, reach: int = 2, radii: tuple[int, ...] = (1, 2, 4), strength: float = 0.8, sharpen: float = 0.5, least: float = -1.0, most: float = 1.0) -> DataFrame:
    """(frame, y, x, view, hole, known): a forward splat by `by` * v over the splat of a far plate, its holes filled and sharpened.

    The plate has the least value within `reach` cells of the row, so the far side goes on behind what is near. What
    neither covers (not known) goes by `strength` from its own value to known cells of the row.
    """
    seen = visible(df, by * F.col("v"), layers, width).withColumnRenamed("near", "_near")
    plate = df.select("frame", "y", "x", F.min("v").over(along("x", reach)).alias("v"))
    behind = visible(plate, by * F.col("v"), layers, width).select("frame", "y", "x", F.col("near").alias("_far"), F.col("valid").alias("_plated"))
    d = by_frame(seen.join(behind, ["frame", "y", "x"])).withColumn("known", F.col("valid") | F.col("_plated"))
    d = d.withColumnRenamed("v", "_own").withColumn("v", F.when(F.col("valid"), F.col("_near")).when(F.col("_plated"), F.col("_far")))
    d = push_pull(d, F.col("known"), radii)
    d = d.withColumn("view", F.when(F.col("known"), F.col("v")).otherwise(F.col("_own") + (F.coalesce("f", "_own") - F.col("_own")) * strength))
    d = pooled(d, F.col("view"), 1, 1, "_box")
    sharp = F.col("view") + (F.col("view") - F.col("_box") / 9) * (0.65 * sharpen)
    view = F.when(F.col("valid"), F.col("view")).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), sharp)))
    return d.select("frame", "y", "x", view.alias("view"), (~F.col("valid")).alias("hole"), "known")


def blurred(df: DataFrame, value: Column, radius: int, sigma: float, name: str) -> DataFrame:
    """Gaussian mean of the (2 radius + 1)² cells about each; at the border, of those that are there."""
    d = df.withColumn(name, value)
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("frame", other).orderBy(axis)
        near = [(math.exp(-i * i / (2 * sigma * sigma)), F.lag(name, i).over(w)) for i in range(-radius, radius + 1)]
        total = sum((F.coalesce(c * share, F.lit(0.0)) for share, c in near), F.lit(0.0))
        weight = sum((F.when(c.isNotNull(), share).otherwise(0.0) for share, c in near), F.lit(0.0))
        d = d.withColumn(name, total / F.nullif(weight, F.lit(0.0)))
    return d


def photo_valid(df: DataFrame, target: str, donor: str, radius: int, most: float = 0.055, least: float = 0.35) -> DataFrame:
    """`df` (v: depth) with ok: about the cell, `target` and `donor` differ by less than `most` where the depth is far, and enough is far.

    Far is what lies at most .01 over the frame's .6 quantile of depth. Cells outside the grid are not far.
    """
    limit = df.groupBy("frame").agg((F.percentile("v", F.lit(0.6)) + 0.01).alias("_limit"))
    d = by_frame(df.join(limit, "frame")).withColumn("_far", (F.col("v") <= F.col("_limit")).cast("double"))
    area = (2 * radius + 1) ** 2
    d = pooled(pooled(d, F.col("_far"), radius, radius, "_w"), F.abs(F.col(target) - F.col(donor)) * F.col("_far"), radius, radius, "_e")
    weight = F.col("_w") / area
    return d.withColumn("ok", (F.col("_e") / area / F.greatest(weight, F.lit(0.01)) < most) & (weight > least)).drop("_limit", "_far", "_w", "_e")


def repaired(points: DataFrame, donors: DataFrame, width: int, height: int, tolerance: float = 0.08, least: float = 0.7) -> DataFrame:
    """Unknown cells from other frames: `points` (frame, y, x, far, ok) with donor and value of the first donor that fits, else null.

    `points` has a row per unknown cell and donor: its number, confidence, and where the cell lies in it (px, py).
    `donors` (frame, donor, y, x, v, depth) is read about those places only. A donor fits if the place lies inside,
    its depth there differs from far by at most `tolerance`, ok holds and its confidence is at least `least`.
    """
    key = F.struct("frame", "donor").alias("frame")
    places = points.select(key, "y", "x", "px", "py")
    seen = sampled(places, donors.select(key, "y", "x", "v", "depth"), width, height, {"v": "_v", "depth": "_depth"})
    both = points.join(seen.select("frame.frame", "frame.donor", "y", "x", "_v", "_depth"), ["frame", "donor", "y", "x"], "left")
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    fits = inside & F.col("ok") & (F.abs(F.col("_depth") - F.col("far")) <= tolerance) & (F.col("confidence") >= least)
    first = F.min(F.when(fits, F.struct("donor", F.col("_v").alias("value")))).alias("_first")
    return both.groupBy("frame", "y", "x").agg(first).select("frame", "y", "x", "_first.donor", "_first.value")


def grown_to_side(df: DataFrame, mask: Column, span: int, vertical: int, to_left: bool, name: str) -> DataFrame:
    """`mask` grown by `span` cells to one side only, where what occludes lies, and by `vertical` rows; as it is where the span is none."""
    if span <= 0:
        return df.withColumn(name, mask)
    row = Window.partitionBy("frame", "y").orderBy("x")
    wide = F.max(mask.cast("int")).over(row.rowsBetween(0, span) if to_left else row.rowsBetween(-span, 0))
    return df.withColumn("_s", wide).withColumn(name, F.max("_s").over(along("y", vertical)) > 0).drop("_s")


def mirrored_runs(df: DataFrame, hole: Column, name: str) -> DataFrame:
    """Each run of holes in a row reflects what lies right of it, the row's last cell at most; a run that ends the row stays."""
    w = Window.partitionBy("frame", "y").orderBy("x")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.first(F.when(~hole, F.col("x")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    source = F.least(F.max("x").over(whole), 2 * end - F.col("x") - 1)
    return df.withColumn(name, F.when(hole & end.isNotNull(), F.get(F.collect_list("v").over(whole), source)).otherwise(F.col("v")))


def bilateral(df: DataFrame, value: str, radius: int, alike: float, near: float, name: str) -> DataFrame:
    """Mean of the disc about each cell by Gaussian weights of distance (`near`) and of difference (`alike`); what is outside the grid has none."""
    disc = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    d, taps_ = by_frame(df), []
    for i, dy in enumerate(sorted({dy for _, dy in disc})):
        d = d.withColumn(f"_r{i}", F.lead(value, dy).over(Window.partitionBy("frame", "x").orderBy("y")) if dy >= 0 else F.lag(value, -dy).over(Window.partitionBy("frame", "x").orderBy("y")))
        for dx in [dx for dx, own in disc if own == dy]:
            row = Window.partitionBy("frame", "y").orderBy("x")
            v = F.lead(f"_r{i}", dx).over(row) if dx >= 0 else F.lag(f"_r{i}", -dx).over(row)
            taps_.append((f"_t{len(taps_)}", v, math.exp(-(dx * dx + dy * dy) / (2 * near * near))))
    d = d.withColumns({n: v for n, v, _ in taps_})
    weights = [F.coalesce(w * F.exp(-F.pow(F.col(n) - F.col(value), F.lit(2.0)) / (2 * alike * alike)), F.lit(0.0)) for n, _, w in taps_]
    total = lambda columns: sum(columns[1:], columns[0])
    mean = total([w * F.coalesce(n, F.lit(0.0)) for w, (n, _, _) in zip(weights, taps_, strict=True)]) / total(weights)
    return d.withColumn(name, mean).select(*df.columns, name)


def seam_score(df: DataFrame, hole: Column) -> DataFrame:
    """frame and score: how far values jump where a run of holes in a row ends at its right; null without such an end.

    An end counts the jump to the next cell, .55 of the jump's change behind it and .15 of the bend along the column;
    ends in the first and last row, or with fewer than two cells behind, do not count.
    """
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    d = by_frame(df).withColumn("_h", hole).withColumns({"_n": F.lead("_h").over(row), "_1": F.lead("v").over(row), "_2": F.lead("v", 2).over(row)})
    d = d.withColumns({"_up": F.lag("v").over(column), "_down": F.lead("v").over(column)})
    v, jump = F.col("v"), F.col("v") - F.col("_1")
    error = F.abs(jump) + 0.55 * F.abs(jump - (F.col("_1") - F.col("_2"))) + 0.15 * F.abs(F.col("_up") - 2 * v + F.col("_down"))
    return d.groupBy("frame").agg(F.avg(F.when(F.col("_h") & ~F.col("_n"), error)).alias("score"))
