"""Queries of grid kernels, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import grids as G

from .registry import CELLS, cells, lagged_cells, query


def _box(value: str, source: str, name: str, r: int) -> str:
    """CTEs that give `name` = mean of `value` over a box."""
    return f"""{name}_r as (select *, sum({value}) over (partition by frame, y order by x rows between {r} preceding and {r} following) as s_, count({value}) over (partition by frame, y order by x rows between {r} preceding and {r} following) as n_ from {source}),
  {name}_t as (select * exclude (s_, n_), sum(s_) over (partition by frame, x order by y rows between {r} preceding and {r} following) / sum(n_) over (partition by frame, x order by y rows between {r} preceding and {r} following) as {name} from {name}_r)"""


@query(f"{CELLS}, q as (select frame, quantile_cont(v, 0.02) as a, quantile_cont(v, 0.98) as b from cl group by frame) select cl.frame, y, x, round(case when b - a < 1e-6 then 0.5 else 0.02 + 0.96 * pow(greatest(0, least(1, (v - a) / (b - a))), 0.8) end, 6) as d from cl join q using (frame)")
def normalise_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalised(cells(spark, sf_dir)).select("frame", "y", "x", F.round("d", 6).alias("d"))


@query(f"{CELLS} select a.frame, a.y, a.x, round(exp(-6 * abs(b.v - a.v)), 6) as confidence, (a.x + 1 <= 7 and a.y - 1 >= 0) as inside from cl a join cl b on b.frame = a.frame and b.x = least(7, a.x + 1) and b.y = greatest(0, a.y - 1)")
def flow_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each cell with the one that an integer flow (1, -1) points at."""
    s = G.shifted(cells(spark, sf_dir), 1, -1, "warped")
    return s.select("frame", "y", "x", F.round(F.exp(-6 * F.abs(F.col("warped") - F.col("v"))), 6).alias("confidence"), ((F.col("x") + 1 <= 7) & (F.col("y") - 1 >= 0)).alias("inside"))


@query(f"{CELLS}, p as (select *, lag(v) over (partition by scene, y, x order by frame) as was from cl), h as (select *, 0.22 * least(1, abs(v) * 4) * exp(-abs(v - was) / 1.5) as h from p where was is not null) select frame, y, x, round(v - (v - was) * h, 8) as flow from h")
def stabilise_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lagged_cells(spark, sf_dir)
    h = 0.22 * F.least(F.lit(1.0), F.abs("v") * 4) * F.exp(-F.abs(F.col("v") - F.col("was")) / 1.5)
    return p.select("frame", "y", "x", F.round(F.col("v") - (F.col("v") - F.col("was")) * h, 8).alias("flow"))


@query(f"""{CELLS}, g as (select *, coalesce(lead(v) over (partition by frame, y order by x), v) - coalesce(lag(v) over (partition by frame, y order by x), v) as gx, coalesce(lead(v) over (partition by frame, x order by y), v) - coalesce(lag(v) over (partition by frame, x order by y), v) as gy from cl)
  select frame, y, x, round(case when v < -0.2 then 0 else least(1, abs(v) * 3) * exp(-0.18 * greatest(abs(gx), abs(gy))) end, 8) as confidence from g""")
def occlusion_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence lowered where neighbours differ; none where a cell is not valid."""

    def gradient(axis: str, other: str):
        w = Window.partitionBy("frame", other).orderBy(axis)
        return F.abs(F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v")))

    c = F.least(F.lit(1.0), F.abs("v") * 3) * F.exp(-0.18 * F.greatest(gradient("x", "y"), gradient("y", "x")))
    return G.by_frame(cells(spark, sf_dir)).select("frame", "y", "x", F.round(F.when(F.col("v") < -0.2, 0.0).otherwise(c), 8).alias("confidence"))


@query(f"""{CELLS}, c0 as (select *, (frame % 7) / 10.0 + x / 20.0::double as i_, greatest(0.02, least(0.98, v + 0.5)) as p_ from cl), {_box('i_', 'c0', 'mi', 2)}, {_box('p_', 'mi_t', 'mp', 2)}, {_box('i_ * i_', 'mp_t', 'ii', 2)}, {_box('i_ * p_', 'ii_t', 'ip', 2)},
  ab as (select *, (ip - mi * mp) / (ii - mi * mi + 0.0025) as a_ from ip_t), ab2 as (select *, mp - a_ * mi as b_ from ab), {_box('a_', 'ab2', 'ma', 2)}, {_box('b_', 'ma_t', 'mb', 2)}
  select frame, y, x, round(greatest(0.02, least(0.98, 0.35 * p_ + 0.65 * (ma * i_ + mb))), 6) as d from mb_t""")
def guided_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    guide = ((F.col("frame") % 7) / 10.0 + F.col("x") / 20.0).cast("double")
    out = G.guided(cells(spark, sf_dir), guide, F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("v") + 0.5)))
    return out.select("frame", "y", "x", F.round("d", 6).alias("d"))


@query(f"{CELLS}, {_box('v', 'cl', 'm', 1)} select frame, y, x, round(v + (m - v) * exp(-28 * abs(v - m)) * least(1, 3 / 6.0), 8) as v from m_t")
def edge_aware_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box(G.by_frame(cells(spark, sf_dir)), F.col("v"), 1, "m")
    gate = F.exp(-28 * F.abs(F.col("v") - F.col("m"))) * 0.5
    return b.select("frame", "y", "x", F.round(F.col("v") + (F.col("m") - F.col("v")) * gate, 8).alias("v"))


@query(f"""{CELLS}, {_box('v', 'cl', 'm', 1)}, e as (select *, max(v) over (partition by frame, y order by x rows between 1 preceding and 1 following) as mx, min(v) over (partition by frame, y order by x rows between 1 preceding and 1 following) as mn from m_t),
  f as (select *, max(mx) over (partition by frame, x order by y rows between 1 preceding and 1 following) as near, min(mn) over (partition by frame, x order by y rows between 1 preceding and 1 following) as far from e)
  select frame, y, x, round(v + (case when v >= m then near else far end - v) * greatest(0, least(1, 12 * (near - far))), 8) as v from f""")
def gradient_aware_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.box(G.by_frame(cells(spark, sf_dir)), F.col("v"), 1, "m")
    d = G.extreme(G.extreme(d, F.col("v"), 1, "near", True), F.col("v"), 1, "far", False)
    pick = F.when(F.col("v") >= F.col("m"), F.col("near")).otherwise(F.col("far"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 12 * (F.col("near") - F.col("far"))))
    return d.select("frame", "y", "x", F.round(F.col("v") + (pick - F.col("v")) * share, 8).alias("v"))


@query(f"{CELLS} select frame, y, x, arg_min(x, (v, x)) over (partition by frame, y order by x rows between 2 preceding and 2 following) as source, min(v) over (partition by frame, y order by x rows between 2 preceding and 2 following) as depth from cl")
def background_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The farthest cell within two of each, the first of equals."""
    w = G.along("x", 2)
    return cells(spark, sf_dir).select("frame", "y", "x", F.min_by("x", F.struct("v", "x")).over(w).alias("source"), F.min("v").over(w).alias("depth"))


_FILL = "partition by frame, y order by x rows between {0} preceding and {0} following"


@query(f"{CELLS}, a as (select *, case when v > 0.05 then v end as f0 from cl), b as (select *, coalesce(f0, avg(f0) over ({_FILL.format(1)})) as f1 from a), c as (select *, coalesce(f1, avg(f1) over ({_FILL.format(2)})) as f2 from b) select frame, y, x, round(coalesce(f2, avg(f2) over ({_FILL.format(4)})), 8) as f from c")
def push_pull_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.push_pull(cells(spark, sf_dir), F.col("v") > 0.05, (1, 2, 4)).select("frame", "y", "x", F.round("f", 8).alias("f"))


@query(f"""{CELLS}, h as (select *, (v > 0.1)::int as m from cl), {_box('m', 'h', 'density', 2)} select frame, y, x, density >= 0.24 as dense, max(m) over (partition by frame, y order by x rows between 0 preceding and 3 following) as toward_left, max(m) over (partition by frame, y order by x rows between 3 preceding and 0 following) as toward_right from density_t""")
def guard_and_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of a mask over 5 x 5 cells, and its one-sided dilations by three."""
    m = G.by_frame(cells(spark, sf_dir)).withColumn("m", (F.col("v") > 0.1).cast("int"))
    d = G.box(m, F.col("m"), 2, "density")
    row = Window.partitionBy("frame", "y").orderBy("x")
    return d.select("frame", "y", "x", (F.col("density") >= 0.24).alias("dense"), F.max("m").over(row.rowsBetween(0, 3)).alias("toward_left"), F.max("m").over(row.rowsBetween(-3, 0)).alias("toward_right"))


@query(f"""{CELLS}, p as (select *, x + 0.25 as px, y + 0.5 as py from cl), t as (select frame, y as ty, x as tx, floor(px)::int + ox as x, floor(py)::int + oy as y, abs(1 - ox - (px - floor(px))) * abs(1 - oy - (py - floor(py))) as w from p, range(2) a(ox), range(2) b(oy))
  select t.frame, ty as y, tx as x, round(sum(coalesce(v, 0) * w), 8) as sampled from t left join cl on cl.frame = t.frame and cl.y = t.y and cl.x = t.x group by t.frame, ty, tx""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.bilinear(cells(spark, sf_dir), F.col("x") + 0.25, F.col("y") + 0.5, "sampled")
    return out.select("frame", "y", "x", F.round("sampled", 8).alias("sampled"))


@query(f"""{CELLS}, h as (select *, v < 0 as hole, case when v < 0 then x - row_number() over (partition by frame, y, v < 0 order by x) end as isle from cl),
  r as (select *, (row_number() over (partition by frame, y, isle order by x) - 0.5) / count(*) over (partition by frame, y, isle) as a from h where hole)
  select frame, y, x, round(a * a * (3 - 2 * a), 8) as alpha from r""")
def directional_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth ramp across each run of holes."""
    h = cells(spark, sf_dir).where("v < 0").withColumn("isle", F.col("x") - F.row_number().over(Window.partitionBy("frame", "y").orderBy("x")))
    run = Window.partitionBy("frame", "y", "isle")
    a = (F.row_number().over(run.orderBy("x")) - 0.5) / F.count("*").over(run)
    return h.withColumn("a", a).select("frame", "y", "x", F.round(F.col("a") * F.col("a") * (3 - 2 * F.col("a")), 8).alias("alpha"))


@query(f"{CELLS}, u as (select *, least(1, abs(v) * 4) as c from cl) select frame, y, x, round(v * c / greatest(c, 1 / 255.0), 8) as flow, round(greatest(0, least(1, 1 - 1.15 * c)), 8) as bias, c > 1e-4 as usable from u")
def unpremultiplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow that was multiplied by its confidence, divided by it again where that can be done."""
    u = cells(spark, sf_dir).withColumn("c", F.least(F.lit(1.0), F.abs("v") * 4))
    return u.select("frame", "y", "x", F.round(F.col("v") * F.col("c") / F.greatest("c", F.lit(1 / 255.0)), 8).alias("flow"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 1.15 * F.col("c"))), 8).alias("bias"), (F.col("c") > 1e-4).alias("usable"))


@query(f"{CELLS} select frame, y, x + 8 * (frame % 2)::int as px, round(v * 0.7 + 0.3 * abs(v), 8) as v, case when v < 0 then 0.0 else v end as pasted from cl")
def packed_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two eyes side by side, blended; and a paste inside a mask only."""
    return cells(spark, sf_dir).select("frame", "y", (F.col("x") + 8 * (F.col("frame") % 2).cast("int")).alias("px"), F.round(F.col("v") * 0.7 + 0.3 * F.abs("v"), 8).alias("v"), F.when(F.col("v") < 0, 0.0).otherwise(F.col("v")).alias("pasted"))
