"""Repairs of grids from other frames and from their own background, and how well these fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import fields
from cadenza.operators import grids as G
from cadenza.operators import sequences as S

from .registry import CELLS, cells, lagged_cells, query, whole_grids
from .view_queries import _AT

_BEFORE = f"{CELLS}, h as (select *, lag(v) over (partition by scene, y, x order by frame) as was from cl), d as (select * from h where was is not null)"


@query(f"""{_BEFORE}, p as (select *, greatest(0, least(7, x + v * 8 * 0.5 * least(1, abs(v) * 4))) as px, greatest(0, least(7, y - v * 4 * 0.5 * least(1, abs(v) * 4))) as py from d), {_AT.format("p", "was")}
  select p.frame, p.y, p.x, round(sampled + (v - sampled) * 0.5, 6) as between from p join p_s using (frame, y, x)""")
def between_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half way between two frames: the earlier one, drawn back along half the motion as far as it is sure, mixed with the later."""
    h = lagged_cells(spark, sf_dir)
    share = 0.5 * F.least(F.lit(1.0), F.abs("v") * 4)
    points = h.withColumns({"px": F.col("x") + F.col("v") * 8 * share, "py": F.col("y") - F.col("v") * 4 * share})
    back = G.sampled(points, h, 8, 8, {"was": "earlier"})
    return h.join(back, ["frame", "y", "x"]).select("frame", "y", "x", F.round(F.col("earlier") + (F.col("v") - F.col("earlier")) * 0.5, 6).alias("between"))


@query(f"""{CELLS}, u as (select *, least(1, abs(v) * 4) * (x <> 3)::int as c from cl), f as (select frame, y, x, v * c / greatest(c, 1 / 255.0::double) as flow, c from u),
  p as (select frame, yy as y, xx as x, (1 + xx) * (7 / 14::double) as px, (2 + yy) * (7 / 14::double) as py from (select distinct frame from cl), range(4) a(yy), range(4) b(xx)),
  t as (select frame, y, x, least(7, floor(px)::int + ox) as sx, least(7, floor(py)::int + oy) as sy, abs(1 - ox - (px - floor(px))) * abs(1 - oy - (py - floor(py))) as w from p, range(2) a(ox), range(2) b(oy))
  select t.frame, t.y::int as y, t.x::int as x, round(sum(flow * w), 6) as flow, round(sum(c * w), 6) as confidence from t join f on f.frame = t.frame and f.y = t.sy and f.x = t.sx group by t.frame, t.y, t.x""")
def motion_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow and its confidence on the cells of a square: 4 x 4 at (1, 2) of a source of 15 x 15, read from the 8 x 8 grid."""
    sure = lambda v, i: F.least(F.lit(1.0), F.abs(v) * 4) * (i % 8 != 3).cast("int")
    flow = lambda v, i: v * sure(v, i) / F.greatest(sure(v, i), F.lit(1 / 255.0))
    grids = whole_grids(spark, sf_dir).select("frame", fields.summed(flow).alias("flow"), fields.summed(sure).alias("confidence"))
    places = [(y, x, (1 + x) * (7 / 14), (2 + y) * (7 / 14)) for y in range(4) for x in range(4)]
    out = fields.resampled(grids, 8, 8, places, {"flow": G.linear, "confidence": G.linear})
    return out.select("frame", "y", "x", F.round("flow", 6).alias("flow"), F.round("confidence", 6).alias("confidence"))


_PHOTO = f"""{_BEFORE}, q as (select frame, quantile_cont(v, 0.6) + 0.01 as top from d group by frame), a as (select d.*, (v <= top)::int as far from d join q using (frame)),
  n as (select a.frame, a.y, a.x, sum(b.far) / 9::double as weight, sum(abs(b.v - b.was) * b.far) / 9::double as error from a join a b on a.frame = b.frame and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by a.frame, a.y, a.x),
  ph as (select frame, y, x, error / greatest(weight, 0.01) < 0.14 and weight > 0.35 as ok from n)"""


def _photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.photo_valid(lagged_cells(spark, sf_dir), "v", "was", 1, 0.14)


@query(f"{_PHOTO} select frame, y, x, ok from ph")
def photo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the frame before looks like this one about a cell, as far as the background goes."""
    return _photo(spark, sf_dir).select("frame", "y", "x", "ok")


@query(f"""{_PHOTO}, g as (select *, least(v, coalesce(lag(v) over r, v), coalesce(lag(v, 2) over r, v), coalesce(lead(v) over r, v), coalesce(lead(v, 2) over r, v)) as back from d window r as (partition by frame, y order by x)),
  pt as (select g.frame, g.y, g.x, back as far, ok, donor, (g.frame + donor) % 10 / 10.0::double as confidence, g.x + 0.5::double * donor as px, g.y + 0.25::double as py from g join ph using (frame, y, x), range(1, 3) r(donor) where v < -0.1),
  dn as (select frame, 1 as donor, y, x, was as v, was - 0.02 as depth from d union all select frame, 2, y, x, v * 0.5, v * 0.5 - 0.1 from d),
  s as (select pt.frame, pt.donor, pt.y, pt.x, sum(dn.v * w) as value, sum(dn.depth * w) as depth from (select *, abs(1 - ox - (cx - floor(cx))) * abs(1 - oy - (cy - floor(cy))) as w from (select *, least(7, px) as cx, least(7, py) as cy from pt), range(2) a(ox), range(2) b(oy)) pt
    join dn on dn.frame = pt.frame and dn.donor = pt.donor and dn.y = least(7, floor(cy)::int + oy) and dn.x = least(7, floor(cx)::int + ox) group by pt.frame, pt.donor, pt.y, pt.x),
  f as (select pt.frame, pt.y, pt.x, pt.donor, value, px <= 7 and py <= 7 and ok and abs(depth - far) <= 0.08 and confidence >= 0.7 as fits from pt join s using (frame, donor, y, x))
  select frame, y, x, min(donor) filter (fits)::int as donor, round(arg_min(value, donor) filter (fits), 6) as value from f group by frame, y, x""")
def sparse_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown cells (under -.1) from the first of two other frames that fits in place, depth, look and confidence."""
    reach = G.along("x", 2)
    d = _photo(spark, sf_dir).withColumn("far", F.min("v").over(reach))
    points = d.where("v < -0.1").withColumn("donor", F.explode(F.array(F.lit(1), F.lit(2))))
    points = points.withColumns({"confidence": (F.col("frame") + F.col("donor")) % 10 / 10.0, "px": F.col("x") + 0.5 * F.col("donor"), "py": F.col("y") + 0.25})
    two = F.array(F.struct(F.lit(1).alias("donor"), F.col("was").alias("v"), (F.col("was") - 0.02).alias("depth")), F.struct(F.lit(2).alias("donor"), (F.col("v") * 0.5).alias("v"), (F.col("v") * 0.5 - 0.1).alias("depth")))
    donors = lagged_cells(spark, sf_dir).select("frame", "y", "x", F.explode(two).alias("d")).select("frame", "y", "x", "d.*")
    out = G.repaired(points.select("frame", "y", "x", "donor", "far", "ok", "confidence", "px", "py"), donors, 8, 8)
    return out.select("frame", "y", "x", "donor", F.round("value", 6).alias("value"))


@query(f"""{CELLS}, e as (select a.frame, abs(a.v - b.v) + 0.55 * abs((a.v - b.v) - (b.v - c.v)) + 0.15 * abs(u.v - 2 * a.v + d.v) as error from cl a
    join cl b on b.frame = a.frame and b.y = a.y and b.x = a.x + 1 join cl c on c.frame = a.frame and c.y = a.y and c.x = a.x + 2
    join cl u on u.frame = a.frame and u.x = a.x and u.y = a.y - 1 join cl d on d.frame = a.frame and d.x = a.x and d.y = a.y + 1 where a.v < -0.05 and b.v >= -0.05)
  select frame, round(avg(error), 6) as score from (select distinct frame from cl) left join e using (frame) group by frame""")
def background_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far values jump on the background's side of holes (under -.05)."""
    return G.seam_score(cells(spark, sf_dir), F.col("v") < -0.05).select("frame", F.round("score", 6).alias("score"))


@query(f"""{CELLS}, g as (select *, v < -0.05 as hole, sin(9 * v) as made from cl), w as (
    select a.frame, a.y, a.x, sum(b.made * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2.0::double)) / sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 2.0::double)) as low from g a join g b on a.frame = b.frame and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by a.frame, a.y, a.x),
  p as (select g.*, coalesce((select arg_min(k.v, k.x) from g k where k.frame = g.frame and k.y = g.y and not k.hole and k.x >= g.x), (select arg_max(k.v, k.x) from g k where k.frame = g.frame and k.y = g.y and not k.hole and k.x < g.x)) as prior from g)
  select frame, y, x, round(case when hole then made + (coalesce(prior, made) + 0.6 * greatest(-0.1, least(0.1, made - low)) - made) * 0.8 else made end, 6) as fused from p join w using (frame, y, x)""")
def fused_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made values in holes (under -.05), drawn to the known background of their row with the made detail, which is bounded, on top."""
    g = G.by_frame(cells(spark, sf_dir)).withColumns({"hole": F.col("v") < -0.05, "made": F.sin(9 * F.col("v"))})
    g = G.blurred(g, F.col("made"), 2, 1.0, "low").withColumn("prior", S.filled(F.when(~F.col("hole"), F.col("v")), ["frame", "y"], "x", True))
    detail = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.col("made") - F.col("low")))
    fused = F.coalesce("prior", "made") + 0.6 * detail
    return g.select("frame", "y", "x", F.round(F.when(F.col("hole"), F.col("made") + (fused - F.col("made")) * 0.8).otherwise(F.col("made")), 6).alias("fused"))


_CUBIC = "case {0} when -1 then -0.5 * {1} + {1} ** 2 - 0.5 * {1} ** 3 when 0 then 1 - 2.5 * {1} ** 2 + 1.5 * {1} ** 3 when 1 then 0.5 * {1} + 2 * {1} ** 2 - 1.5 * {1} ** 3 else -0.5 * {1} ** 2 + 0.5 * {1} ** 3 end"


@query(f"""{CELLS}, u as (select *, least(1, abs(v) * 4) as c, v * least(1, abs(v) * 4) as flow from cl),
  n as (select frame, yy as y, xx as x, greatest(0, least(7, (xx + 0.5) * (8 / 10::double) - 0.5)) as px, greatest(0, least(7, (yy + 0.5) * (8 / 6::double) - 0.5)) as py from (select distinct frame from cl), range(6) a(yy), range(10) b(xx)),
  t as (select frame, y, x, floor(px)::int as x0, floor(py)::int as y0, px - floor(px) as tx, py - floor(py) as ty from n),
  c4 as (select t.frame, t.y, t.x, sum(u.v * ({_CUBIC.format("ox", "tx")}) * ({_CUBIC.format("oy", "ty")})) as colour from t, range(-1, 3) a(ox), range(-1, 3) b(oy), u where u.frame = t.frame and u.x = greatest(0, least(7, x0 + ox)) and u.y = greatest(0, least(7, y0 + oy)) group by all),
  c2 as (select t.frame, t.y, t.x, sum(u.flow * abs(1 - ox - tx) * abs(1 - oy - ty)) as flow, sum(u.c * abs(1 - ox - tx) * abs(1 - oy - ty)) as c from t, range(2) a(ox), range(2) b(oy), u where u.frame = t.frame and u.x = least(7, x0 + ox) and u.y = least(7, y0 + oy) group by all)
  select frame, y::int as y, x::int as x, round(colour, 6) as colour, round(case when c > 1e-4 then flow / c else 0 end, 6) as flow, round(greatest(0, least(1, 1 - 1.15 * c)), 6) as bias from c4 join c2 using (frame, y, x)""")
def expanded_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids on 10 x 6 cells: values by a cubic curve, flow and its confidence linearly, the flow then freed of it where it is there."""
    sure = lambda v: F.least(F.lit(1.0), F.abs(v) * 4)
    grids = whole_grids(spark, sf_dir).select("frame", fields.summed(lambda v: v).alias("colour"), fields.summed(lambda v: v * sure(v)).alias("f"), fields.summed(sure).alias("sure"))
    both = fields.resampled(grids, 8, 8, fields.centres(8, 8, 6, 10), {"colour": G.cubic, "f": G.linear, "sure": G.linear})
    flow = F.when(F.col("sure") > 1e-4, F.col("f") / F.col("sure")).otherwise(0.0)
    bias = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 1.15 * F.col("sure")))
    return both.select("frame", "y", "x", F.round("colour", 6).alias("colour"), F.round(flow, 6).alias("flow"), F.round(bias, 6).alias("bias"))


@query(f"""{CELLS}, m as (select *, (v > 0.1)::int as m from cl),
  a as (select *, max(m) over (partition by frame, y order by x rows between current row and 3 following) as l, max(m) over (partition by frame, y order by x rows between 2 preceding and current row) as r from m)
  select frame, y, x, max(l) over w > 0 as left_grown, max(r) over w > 0 as right_grown, m = 1 as compose, round(case when m = 1 then -v else v end, 6) as pasted from a window w as (partition by frame, x order by y rows between 1 preceding and 1 following)""")
def model_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that a model sees, grown over what occludes, to one side; the mask to compose by stays, and only inside it something is pasted."""
    c = G.by_frame(cells(spark, sf_dir)).withColumn("compose", F.col("v") > 0.1)
    c = G.grown_to_side(c, F.col("compose"), 3, 1, True, "left_grown")
    c = G.grown_to_side(c, F.col("compose"), 2, 1, False, "right_grown")
    return c.select("frame", "y", "x", "left_grown", "right_grown", "compose", F.round(F.when(F.col("compose"), -F.col("v")).otherwise(F.col("v")), 6).alias("pasted"))


@query(f"""{CELLS}, e as (select *, v <= 0 as hole, first_value(case when v > 0 then x end ignore nulls) over (partition by frame, y order by x rows between current row and unbounded following) as edge from cl),
  s as (select e.*, case when hole and edge is not null then least(7, 2 * edge - x - 1) else x end as src from e),
  m as (select s.frame, s.y, s.x, s.hole, c.v as mirrored from s join cl c on c.frame = s.frame and c.y = s.y and c.x = s.src),
  w as (select a.frame, a.y, a.x, a.hole, a.mirrored, b.mirrored as o, exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 18.0::double) * exp(-((b.mirrored - a.mirrored) ** 2) / (2 * 0.07 * 0.07)::double) as w from m a join m b on a.frame = b.frame and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4)
  select frame, y, x, hole, round(case when hole then sum(w * o) / sum(w) else max(mirrored) end, 6) as filled from w group by frame, y, x, hole""")
def smoothed_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cells not above 0 mirror what is right of them and are smoothed without crossing edges; all others stay."""
    m = G.mirrored_runs(cells(spark, sf_dir).withColumn("hole", F.col("v") <= 0), F.col("hole"), "mirrored")
    b = G.bilateral(m, "mirrored", 2, 0.07, 3.0, "smooth")
    return b.select("frame", "y", "x", "hole", F.round(F.when(F.col("hole"), F.col("smooth")).otherwise(F.col("mirrored")), 6).alias("filled"))
