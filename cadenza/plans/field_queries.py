"""Flow chained through frames, its round trip, grids that recur, and soft masks. Fifty vectors are a scene of frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import consensus as R
from cadenza.operators import fields as V
from cadenza.operators import grids as G

from .registry import CELLS, cells, query, table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, frame, e: the embeddings as whole grids."""
    return table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 50)).alias("scene"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("e"))


_FRAMES = "fr as (select vec_id // 50 as scene, vec_id as frame, list_transform(embedding, lambda v: v::double) as e from embeddings)"


def scaled(column, by: float, shift: float = 0.0):
    return F.transform(column, lambda v: v * by + shift)


def exploded(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row per cell, numbers rounded."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("cell", "c"))
    kinds = {f.name: f.dataType.elementType.typeName() for f in df.schema.fields if f.name in columns}
    return rows.select(*keys, "cell", *((F.round(F.col(f"c.{c}"), 6) if kinds[c] == "double" else F.col(f"c.{c}")).alias(c) for c in columns))


def _each(expression: str) -> str:
    """A list over the 64 cells i."""
    return f"list_transform(range(64), lambda i: {expression})"


def _tap(values: str, x: str, y: str, edge: str) -> str:
    """SQL of a bilinear sample of a list at (x, y)."""
    if edge == "nearest":
        x, y = f"greatest(0, least(7, {x}))", f"greatest(0, least(7, {y}))"
    taps = []
    for oy in (0, 1):
        for ox in (0, 1):
            cx, cy = f"(floor({x}) + {ox})", f"(floor({y}) + {oy})"
            w = f"abs({1 - ox} - ({x} - floor({x}))) * abs({1 - oy} - ({y} - floor({y})))"
            taps.append(f"case when {cx} between 0 and 7 and {cy} between 0 and 7 then {values}[({cy} * 8 + {cx})::int + 1] * {w} else 0 end")
    return "(" + " + ".join(taps) + ")"


_EDGES = f"""ed as (select scene, frame, case when frame % 7 <> 3 then {_each("e[i + 1] * 4")} end as ndx, {_each("e[i + 1] * -2 + 0.25")} as ndy, {_each("1 - least(1, abs(e[i + 1]) * 2)")} as ncf,
  {_each("e[i + 1] * -3")} as pdx, {_each("e[i + 1] - 0.5")} as pdy, {_each("1 - least(1, abs(e[i + 1]))")} as pcf from fr)"""


def _chain(name: str, prefix: str, sign: int, hops: int) -> str:
    parts = [f"{name}0 as (select scene, frame, {_each('0.0::double')} as tx, {_each('0.0::double')} as ty, {_each('1.0::double')} as c, true as alive from fr)"]
    for k in range(hops):
        at = lambda v: _tap(v, "px[i + 1]", "py[i + 1]", "zero")
        parts.append(f"{name}{k}j as (select h.*, e.{prefix}dx as dx, e.{prefix}dy as dy, e.{prefix}cf as cf, {_each('i % 8 + h.tx[i + 1]')} as px, {_each('i // 8 + h.ty[i + 1]')} as py, h.alive and e.{prefix}dx is not null as ok from {name}{k} h left join ed e on e.scene = h.scene and e.frame = h.frame + {sign * k})")
        moved = lambda t, d: f"case when ok then {_each(f'{t}[i + 1] + {at(d)}')} else {t} end as {t}"
        parts.append(f"{name}{k + 1} as (select scene, frame, {moved('tx', 'dx')}, {moved('ty', 'dy')}, case when ok then {_each(f'least(c[i + 1], {at("cf")})')} else {_each('0.0::double')} end as c, ok as alive from {name}{k}j)")
    return ", ".join(parts)


@query(f"""with {_FRAMES}, {_EDGES}, {_chain("f", "n", 1, 3)}, {_chain("b", "p", -1, 2)},
  u as (select 'on' as way, frame, unnest(range(64)) as cell, unnest(tx) as dx, unnest(ty) as dy, unnest(c) as confidence from f3 union all select 'back', frame, unnest(range(64)), unnest(tx), unnest(ty), unnest(c) from b2)
  select way, frame, cell, round(dx, 6) as dx, round(dy, 6) as dy, round(confidence, 6) as confidence from u""")
def chained_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where cells are three frames on and two frames back: each hop's flow and confidence are sampled at the displacement so far; a missing edge leaves no confidence."""
    f = frames(spark, sf_dir)
    on = f.select("scene", "frame", F.when(F.col("frame") % 7 != 3, scaled(F.col("e"), 4)).alias("dx"), scaled(F.col("e"), -2, 0.25).alias("dy"), F.transform("e", lambda v: 1 - F.least(F.lit(1.0), F.abs(v) * 2)).alias("confidence"))
    back = f.select("scene", "frame", scaled(F.col("e"), -3).alias("dx"), scaled(F.col("e"), 1, -0.5).alias("dy"), F.transform("e", lambda v: 1 - F.least(F.lit(1.0), F.abs(v))).alias("confidence"))
    both = V.chained(on, 3, 8, 8).withColumn("way", F.lit("on")).unionByName(V.chained(back, 2, 8, 8, back=True).withColumn("way", F.lit("back")))
    return exploded(both, ["way", "frame"], ["dx", "dy", "confidence"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame beside the next of its scene, with flows both ways; images are 0 to 255."""
    f = frames(spark, sf_dir)
    after = f.select("scene", (F.col("frame") - 1).alias("frame"), F.col("e").alias("n"))
    both = f.join(after, ["scene", "frame"])
    image = lambda c: F.transform(c, lambda v: 127.5 + 127.5 * v)
    return both.select("frame", image("e").alias("first"), image("n").alias("second"), scaled(F.col("e"), 3).alias("dx"), scaled(F.col("n"), -2).alias("dy"), scaled(F.col("n"), -3).alias("back_dx"), scaled(F.col("e"), 2).alias("back_dy"), scaled(F.col("e"), 0.2).alias("first_depth"), scaled(F.col("n"), 0.2).alias("second_depth"))


_PAIRS = f"""{_FRAMES}, pr as (select a.frame, {_each("127.5 + 127.5 * a.e[i + 1]")} as f, {_each("127.5 + 127.5 * b.e[i + 1]")} as s, {_each("a.e[i + 1] * 3")} as dx, {_each("b.e[i + 1] * -2")} as dy, {_each("b.e[i + 1] * -3")} as bx, {_each("a.e[i + 1] * 2")} as by_, {_each("a.e[i + 1] * 0.2")} as fd, {_each("b.e[i + 1] * 0.2")} as sd
  from fr a join fr b on b.scene = a.scene and b.frame = a.frame + 1), pl as (select *, {_each("i % 8 + dx[i + 1]")} as px, {_each("i // 8 + dy[i + 1]")} as py from pr)"""


def _way(edge: str) -> str:
    at = lambda v: _tap(v, "px[i + 1]", "py[i + 1]", edge)
    return f"wy as (select *, {_each(f'sqrt(power(dx[i + 1] + {at("bx")}, 2) + power(dy[i + 1] + {at("by_")}, 2))')} as trip, {_each(f'abs(f[i + 1] - {at("s")})')} as photo, {_each(f'abs(fd[i + 1] - {at("sd")})')} as deep from pl)"


@query(f"""with {_PAIRS}, {_way("zero")}, c as (select frame, unnest(range(64)) as cell, unnest({_each("case when px[i + 1] between 0 and 7 and py[i + 1] between 0 and 7 then exp(-trip[i + 1] / greatest(0.65 + 0.035 * sqrt(power(dx[i + 1], 2) + power(dy[i + 1], 2)), 0.001)) * exp(-photo[i + 1] / 28) else 0.0::double end")}) as confidence from wy)
  select frame, cell, round(confidence, 6) as confidence from c""")
def flow_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far to trust a flow: what the flow back leaves of the way, and the other image, both where the flow leads."""
    return exploded(V.reliability(pairs(spark, sf_dir).drop("first_depth", "second_depth"), 8, 8), ["frame"], ["confidence"])


@query(f"""with {_PAIRS}, {_way("nearest")}, c as (select frame, unnest(range(64)) as cell, unnest({_each("trip[i + 1] < 0.75 and photo[i + 1] < 12 and deep[i + 1] < 0.06 and px[i + 1] >= 0 and px[i + 1] < 7 and py[i + 1] >= 0 and py[i + 1] < 7")}) as valid, unnest(dx) as dx, unnest(dy) as dy from wy)
  select frame, cell, valid, round(dx / 7, 6) as u, round(dy / 7, 6) as v from c""")
def flow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells a flow links: round trip, image and depth agree at its end."""
    return exploded(V.validated(pairs(spark, sf_dir), 8, 8), ["frame"], ["valid", "u", "v"])


_WARP = _tap("r.out", "g.px[i + 1]", "g.py[i + 1]", "nearest")


@query(f"""with recursive {_FRAMES}, m as (select *, {_each("(abs(e[i + 1]) * 1000)::bigint % 256")} as cf, {_each("(i + frame) % 5 > 0")} as ok from fr),
  g as (select scene, frame, e, case when frame % 9 <> 4 then {_each("i % 8 + e[i + 1] * 300 / greatest(case when ok[i + 1] then cf[i + 1] / 255.0::double else 0 end, 1 / 255.0::double) * 7 / 639")} end as px, {_each("i // 8 - e[i + 1] * 200 / greatest(case when ok[i + 1] then cf[i + 1] / 255.0::double else 0 end, 1 / 255.0::double) * 7 / 359")} as py, {_each("case when ok[i + 1] then cf[i + 1] / 255.0::double else 0 end * 0.8")} as b from m),
  r as (select scene, frame, e as out from g where frame % 50 = 0 union all
    select g.scene, g.frame, case when g.px is null then {_each("g.e[i + 1] * (1 - 0.8) + r.out[i + 1] * 0.8")} else {_each(f"g.e[i + 1] * (1 - g.b[i + 1]) + {_WARP} * g.b[i + 1]")} end from r join g on g.scene = r.scene and g.frame = r.frame + 1)
  select frame, cell, round(out, 6) as out from (select frame, unnest(range(64)) as cell, unnest(out) as out from r)""")
def compensated_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth smoothed over time: each frame is blended with the last result, drawn along the motion, as far as the motion is trusted."""
    f = frames(spark, sf_dir)
    i = F.sequence(F.lit(0), F.lit(63))
    motion = lambda by: F.when(F.col("frame") % 9 != 4, F.transform("e", lambda v: v * by))
    rows = f.select("scene", "frame", F.col("e").alias("depth"), motion(300).alias("dx"), motion(-200).alias("dy"), F.transform("e", lambda v: F.round(F.abs(v) * 1000).cast("long") % 256).alias("confidence"), F.transform(i, lambda c: (c + F.col("frame")) % 5 > 0).alias("valid"))
    return exploded(V.grid_fold(rows, ["scene"], "frame", V.compensated(0.8, (8, 8), (8, 8), (360, 640)), "out array<double>", ["frame"]), ["frame"], ["out"])


_LIFT = {c: _tap(f"m.{c}", "(i % 8) * 3 / 7.0::double", "(i // 8) * 3 / 7.0::double", "nearest").replace("between 0 and 7", "between 0 and 3").replace("* 8 +", "* 4 +").replace("least(7,", "least(3,") for c in ("dx", "dy", "cf")}


@query(f"""with recursive {_FRAMES}, m as (select *, list_transform(range(16), lambda i: e[i + 1] * 300 / greatest(0.5::double, abs(e[i + 1]))) as dx, list_transform(range(16), lambda i: e[i + 17] * -200 / greatest(0.5::double, abs(e[i + 1]))) as dy, list_transform(range(16), lambda i: greatest(0.5::double, abs(e[i + 1]))) as cf from fr),
  l as (select scene, frame, e, {_each(_LIFT["dx"])} as lx, {_each(_LIFT["dy"])} as ly, {_each(_LIFT["cf"])} as lc from m),
  g as (select scene, frame, e, {_each("i % 8 + lx[i + 1] * 7 / 639")} as px, {_each("i // 8 + ly[i + 1] * 7 / 359")} as py, {_each("least(0.6, lc[i + 1] * 0.6)")} as b from l),
  r as (select scene, frame, e as out from g where frame % 50 = 0 union all
    select g.scene, g.frame, {_each(f"g.e[i + 1] * (1 - g.b[i + 1]) + {_WARP} * g.b[i + 1]")} from r join g on g.scene = r.scene and g.frame = r.frame + 1)
  select frame, cell, round(out, 6) as out from (select frame, unnest(range(64)) as cell, unnest(out) as out from r)""")
def lifted_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with motion on a coarser grid (4 x 4), lifted to the depth's."""
    f = frames(spark, sf_dir)
    trust = F.transform(F.slice("e", 1, 16), lambda v: F.greatest(F.lit(0.5), F.abs(v)))
    rows = f.select("scene", "frame", F.col("e").alias("depth"), F.transform(F.slice("e", 1, 16), lambda v: v * 300).alias("dx"), F.transform(F.slice("e", 17, 16), lambda v: v * -200).alias("dy"), F.transform(trust, lambda v: v * 255).alias("confidence"), F.array_repeat(F.lit(True), 16).alias("valid"))
    return exploded(V.grid_fold(rows, ["scene"], "frame", V.compensated(0.6, (8, 8), (4, 4), (360, 640)), "out array<double>", ["frame"]), ["frame"], ["out"])


_PREV = _tap("r.out", "g.px[i + 1]", "g.py[i + 1]", "nearest")
_NEAR = "(round_even(g.px[i + 1], 0) between 0 and 7 and round_even(g.py[i + 1], 0) between 0 and 7 and r.hole[(greatest(0, least(7, round_even(g.py[i + 1], 0))) * 8 + greatest(0, least(7, round_even(g.px[i + 1], 0))))::int + 1])"


@query(f"""with recursive {_FRAMES}, m as (select scene, frame, frame % 50 as pos, {_each("127.5 + 127.5 * e[i + 1]")} as seed, {_each("e[i + 1] < -0.12")} as hole, {_each("i % 8 + e[i + 1] * 2")} as px, {_each("i // 8 - e[i + 1] * 2")} as py, {_each("1 - least(1, abs(e[i + 1]) * 3)")} as cf from fr),
  g as (select *, {_each("not hole[i + 1] and cf[i + 1] >= 0.4 and list_bool_or(list_transform(range(64), lambda j: hole[j + 1] and abs(j % 8 - i % 8) <= 4 and abs(j // 8 - i // 8) <= 4))")} as ring from m),
  r as (select scene, frame, seed as out, hole, hole as residual, 0::bigint as reused, 1.0::double as photo from g where pos = 0 union all
    select scene, frame, case when photo <= 0.17 then {_each("case when again[i + 1] then seed[i + 1] * (1 - 0.6) + warped[i + 1] * 0.6 else seed[i + 1] end")} else seed end, hole, {_each("hole[i + 1] and not (again[i + 1] and photo <= 0.17 and pos % 8 <> 0)")}, case when photo <= 0.17 and pos % 8 <> 0 then len(list_filter(again, lambda a: a)) else 0 end, photo from (
      select *, coalesce(list_avg(list_transform(list_filter(range(64), lambda i: ring[i + 1]), lambda i: abs(warped[i + 1] - seed[i + 1]))) / 255, 1.0) as photo from (
        select g.scene, g.frame, g.pos, g.seed, g.hole, g.ring, {_each(_PREV)} as warped, {_each(f"g.hole[i + 1] and g.cf[i + 1] >= 0.4 and {_NEAR}")} as again from r join g on g.scene = r.scene and g.frame = r.frame + 1)))
  select frame, cell, round(out, 6) as out, residual, reused, round(photometric, 6) as photometric from (select frame, unnest(range(64)) as cell, unnest(out) as out, unnest(residual) as residual, reused, photo as photometric from r)""")
def reused_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes repaired from the last result where it is known, trusted and alike; every eighth frame all count as left."""
    f = frames(spark, sf_dir)
    flow = lambda by: F.when(F.col("frame") % 50 > 0, scaled(F.col("e"), by))
    rows = f.select("scene", "frame", (F.col("frame") % 50).alias("at"), scaled(F.col("e"), 127.5, 127.5).alias("seed"), F.transform("e", lambda v: v < -0.12).alias("hole"), flow(2).alias("dx"), flow(-2).alias("dy"), F.transform("e", lambda v: 1 - F.least(F.lit(1.0), F.abs(v) * 3)).alias("confidence"))
    out = V.grid_fold(rows, ["scene"], "frame", V.reused(0.4, 0.6, 0.17, (8, 8), 8), "out array<double>, residual array<boolean>, reused long, photometric double", ["frame"])
    return exploded(out, ["frame", "reused", "photometric"], ["out", "residual"]).withColumn("photometric", F.round("photometric", 6))


def _soft(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """A row per cell of what `of` makes from the mask of cells over -.05."""
    masks = frames(spark, sf_dir).select("frame", F.transform("e", lambda v: v > -0.05).alias("mask"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), V.lists(of(V.grids(batch.column(1), 8, 8).astype(bool)))], ["frame", "alpha"])

    return exploded(masks.mapInArrow(run, "frame long, alpha array<double>"), ["frame"], ["alpha"])


@query(f"""{CELLS}, h as (select a.frame, a.y, a.x, min(0.955 * (greatest(abs(a.y - b.y), abs(a.x - b.x)) - least(abs(a.y - b.y), abs(a.x - b.x))) + 1.3693 * least(abs(a.y - b.y), abs(a.x - b.x))) as d
    from cl a join cl b on a.frame = b.frame and b.v <= -0.05 where a.v > -0.05 group by a.frame, a.y, a.x), t as (select frame, y, x, least(1, d / 3) as t from h)
  select cl.frame, (cl.y * 8 + cl.x)::int as cell, round(case when v <= -0.05 then 0 else coalesce(t * t * (3 - 2 * t), 1) end, 6) as alpha from cl left join t on t.frame = cl.frame and t.y = cl.y and t.x = cl.x""")
def inward_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha that is 0 outside a mask and rises smoothly to 1 three steps inside, by a distance in straight and diagonal steps."""
    return _soft(spark, sf_dir, lambda m: V.inward_feather(m, 3.0))


@query(f"""{CELLS}, o as (select unnest(range(-4, 5)) as o), w as (select o, exp(-o * o / 2.0::double) / (select sum(exp(-o * o / 2.0::double)) from o) as w from o),
  a as (select cl.frame, cl.y, cl.x, sum(w * (s.v > -0.05)::int) as m from cl, w join cl s on true where s.frame = cl.frame and s.y = cl.y and s.x = (7 - abs(7 - abs(cl.x + o))) group by cl.frame, cl.y, cl.x),
  b as (select a.frame, a.y, a.x, sum(w * s.m) as m from a, w join a s on true where s.frame = a.frame and s.x = a.x and s.y = (7 - abs(7 - abs(a.y + o))) group by a.frame, a.y, a.x)
  select frame, (y * 8 + x)::int as cell, round(m, 6) as alpha from b""")
def gaussian_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask blurred by a Gaussian of deviation 1."""
    return _soft(spark, sf_dir, lambda m: V.gaussian_feather(m, 1.0))


@query(f"""{CELLS}, k as (select *, case when v >= 0.05 then v end as known from cl)
  select frame, y, x, round(coalesce(known, avg(known) over (partition by frame, y // 2, x // 2), avg(known) over (partition by frame, y // 4, x // 4), avg(known) over (partition by frame, y // 8, x // 8)), 6) as filled from k""")
def pyramid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under .05 are unknown and take the mean of the smallest block that knows any."""
    known = cells(spark, sf_dir).withColumn("known", F.when(F.col("v") >= 0.05, F.col("v")))
    return V.pyramid_fill(known, "known", "filled", 3).select("frame", "y", "x", F.round("filled", 6).alias("filled"))


def _seen_sql() -> str:
    from .view_queries import _AT, _SEEN

    return f"""{_SEEN}, p as (select *, v * 4 as d, greatest(0, least(7, x + v * 4)) as px, y as py from seen), {_AT.format("p", "d")}
  select p.frame, p.y, p.x, not valid and abs(px - sampled - p.x) > 1.5 as hole from p join p_s using (frame, y, x)"""


@query(_seen_sql())
def owner_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a splat leaves uncovered, and whose backward coordinate belongs elsewhere: projected back by the disparity there, it lands over 1.5 cells off."""
    c = cells(spark, sf_dir)
    d = F.col("v") * 4
    seen = G.visible(c, d, 6, 8)
    px = F.greatest(F.lit(0.0), F.least(F.lit(7.0), F.col("x") + d))
    owner = G.sampled(c.withColumns({"px": px, "py": F.col("y")}), c.withColumn("v", d), 8, 8, "own")
    both = seen.join(owner, ["frame", "y", "x"])
    return both.select("frame", "y", "x", (~F.col("valid") & (F.abs(px - F.col("own") - F.col("x")) > 1.5)).alias("hole"))


#: Planted between the images of a frame: a map of shares, given by the frame's number; some matches are wrong.
_MAP = ("1 + 0.01 * (frame % 7)", "0.02 * (frame % 5)", "0.01 * (frame % 3)", "-0.01 * (frame % 4)", "1 - 0.01 * (frame % 6)", "0.02 * (frame % 2)", "0.05 * (frame % 3)", "-0.03 * (frame % 4)", "1.0")
_WRONG = "case when frame % 19 = 5 then i % 5 > 0 when frame % 23 = 6 then i % 2 = 0 else abs(v) > 0.2 end"
_THERE = "case when frame % 11 = 3 then i < 10 when frame % 17 = 4 then i % 8 < 3 else true end"


@query(f"""with p as (select vec_id as frame, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), q as (select frame, i, {_WRONG} as wrong, {_THERE} as there from p),
  n as (select frame, count(*) filter (there) as matches, count(*) filter (there and not wrong) as inliers, coalesce(max(i % 8) filter (there and not wrong) - min(i % 8) filter (there and not wrong), 0) as sx, coalesce(max(i // 8) filter (there and not wrong) - min(i // 8) filter (there and not wrong), 0) as sy from q group by frame),
  r as (select *, case when frame % 13 = 2 then 'no-features' when matches < 18 then 'few-matches' when inliers < 16 then 'few-inliers' when sx * 80 < 640 * 0.35 or sy * 45 < 360 * 0.2 then 'narrow-coverage' when inliers / matches < 0.7 then 'low-confidence' end as reason from n)
  select frame, matches::bigint as matches, reason, case when reason is null then inliers end::bigint as inliers, {", ".join(f"case when reason is null then round(({m})::double, 4) end as m{i}" for i, m in enumerate(_MAP))} from r""")
def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homographies from matches of which some are wrong, and why pairs are rejected; the SQL knows what was planted."""
    cells_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    x, y = F.col("i") % 8 * 80.0, F.floor(F.col("i") / 8) * 45.0
    m = [F.expr(e).cast("double") for e in _MAP]
    a, b = x / 639, y / 359
    z = m[6] * a + m[7] * b + m[8]
    off = F.when(F.expr(_WRONG), 30 + F.col("i") * F.col("i") * 7 % 97).otherwise(0.0)
    matches = cells_.where(F.expr(_THERE)).select(F.col("frame").alias("pair"), x.alias("x"), y.alias("y"), ((m[0] * a + m[1] * b + m[2]) / z * 639 + off).alias("u"), ((m[3] * a + m[4] * b + m[5]) / z * 359 - off * (F.col("i") % 3)).alias("v"))
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair"), F.lit(640).alias("width"), F.lit(360).alias("height"), (F.col("vec_id") % 13 != 2).alias("described"))
    out = R.homographies(matches, sizes)
    return out.select(F.col("pair").alias("frame"), "matches", "reason", "inliers", *((F.round(F.col("m")[i], 4) + 0.0).alias(f"m{i}") for i in range(9)))
