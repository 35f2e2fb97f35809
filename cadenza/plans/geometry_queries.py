"""Queries on sizes, layouts, limits and plans. Parts stand for requests: their keys make sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import geometry as G

from .registry import query, table

REQUESTS = """with rq as (select p_partkey as id, 320 + (p_partkey * 37) % 3800 as w, 240 + (p_partkey * 91) % 2100 as h, p_size as size,
  case p_partkey % 4 when 0 then 'half-sbs' when 1 then 'full-sbs' when 2 then 'half-ou' else 'full-ou' end as layout, case p_partkey % 3 when 0 then 'left' when 1 then 'right' else 'both' end as anchor, case when p_partkey % 2 = 0 then 'nv12' else 'rgb24' end as packing from part)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    choose = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return p.select(k.alias("id"), (320 + (k * 37) % 3800).alias("w"), (240 + (k * 91) % 2100).alias("h"), F.col("p_size").alias("size"), choose("half-sbs", "full-sbs", "half-ou", "full-ou").alias("layout"), choose("left", "right", "both").alias("anchor"), choose("nv12", "rgb24").alias("packing"))


@query(f"{REQUESTS} select id, case when packing = 'nv12' then w * h * 3 // 2 else w * h * 3 end as bytes, ceil(w / ceil(w / greatest(64, size * 8.0)))::bigint as gw, ceil(h / ceil(w / greatest(64, size * 8.0)))::bigint as gh, ceil(w / greatest(64, size * 8.0))::bigint as tile from rq")
def guide_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile, gw, gh = G.guide(F.col("w"), F.col("h"), F.col("size") * 8)
    return requests(spark, sf_dir).select("id", G.frame_bytes(F.col("w"), F.col("h"), F.col("packing")).alias("bytes"), gw.alias("gw"), gh.alias("gh"), tile.alias("tile"))


@query(f"{REQUESTS}, s as (select *, least(1.0::double, greatest(128, size * 20) / greatest(w, h)::double) as k from rq) select id, greatest(128, round_even(w * k / 8, 0) * 8)::bigint as gw, greatest(128, round_even(h * k / 8, 0) * 8)::bigint as gh from s")
def scaled_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    gw, gh = G.scaled_guide(F.col("w"), F.col("h"), F.col("size") * 20)
    return requests(spark, sf_dir).select("id", gw.alias("gw"), gh.alias("gh"))


@query(f"""{REQUESTS} select id, case when layout = 'half-sbs' then w // 2 else w end as eye_w, case when layout = 'half-ou' then h // 2 else h end as eye_h,
  case layout when 'half-sbs' then w // 2 * 2 when 'full-sbs' then w * 2 else w end as packed_w, case layout when 'half-ou' then h // 2 * 2 when 'full-ou' then h * 2 else h end as packed_h from rq""")
def layout_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("eye_w", "eye_h", "packed_w", "packed_h")
    return requests(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(G.layout(F.col("w"), F.col("h"), F.col("layout")), names, strict=True)))


@query(f"{REQUESTS}, s as (select *, least(1920.0::double / w, 1080.0::double / h) as k0 from rq), k as (select *, case when id % 2 = 0 then k0 else least(1.0::double, k0) end as k from s) select id, (2 * greatest(1, floor(w * k / 2)))::bigint as w, (2 * greatest(1, floor(h * k / 2)))::bigint as h, (4 * greatest(16, floor(w / 4.0)))::bigint as w4 from k")
def fit_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.fit(F.col("w"), F.col("h"), F.lit(1920.0), F.lit(1080.0), F.col("id") % 2 == 0)
    return requests(spark, sf_dir).select("id", w.alias("w"), h.alias("h"), G.multiple_of_four(F.col("w")).cast("long").alias("w4"))


@query(f"""{REQUESTS}, s as (select *, least(1.0::double, 512.0::double / greatest(w, h)) as k from rq), i as (select id, (2 * greatest(1, floor(w * k / 2)))::bigint as iw, (2 * greatest(1, floor(h * k / 2)))::bigint as ih from s)
  select id, iw, ih, (ceil(iw / 64) * 64)::bigint as cw, (ceil(ih / 64) * 64)::bigint as ch, ((ceil(iw / 64) * 64)::bigint - iw) // 2 as px, ((ceil(ih / 64) * 64)::bigint - ih) // 2 as py from i""")
def model_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("id", *(c.alias(n) for c, n in zip(G.model_canvas(F.col("w"), F.col("h"), 512), ("iw", "ih", "cw", "ch", "px", "py"), strict=True)))


#: Least memory in MiB, then side and batch.
TIERS = [(0, (384, 3)), (12000, (512, 8)), (20000, (768, 16))]


@query(f"{REQUESTS}, m as (select id, size * 600 as mib from rq) select id, case when mib >= 20000 then 768 when mib >= 12000 then 512 else 384 end as side, case when mib >= 20000 then 16 when mib >= 12000 then 8 else 3 end as batch, case when mib >= 12000 then 'high' else 'standard' end as profile, least(greatest(size * 40, 256), 1024) as clamped from m join rq using (id)")
def memory_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    mib = F.col("size") * 600
    t = G.tiers(mib, TIERS)
    return requests(spark, sf_dir).select("id", t[0].alias("side"), t[1].alias("batch"), F.when(mib >= 12000, "high").otherwise("standard").alias("profile"), F.least(F.greatest(F.col("size") * 40, F.lit(256)), F.lit(1024)).alias("clamped"))


@query(f"""{REQUESTS}, d as (select *, size / 4.0::double * case when anchor = 'both' then 1 else 2 end as d from rq)
  select id, case when d <= 5 then 1 else greatest(2, ceil(d / 4)) end::int as steps, case anchor when 'left' then 0.0 when 'right' then 1.0 else 0.5 end::double as left_factor, case anchor when 'left' then -1.0 when 'right' then 0.0 else -0.5 end::double as right_factor from d""")
def warp_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = G.shift_factors(F.col("anchor"))
    return requests(spark, sf_dir).select("id", G.warp_steps(F.col("size") / 4.0, F.col("anchor") == "both").alias("steps"), left.alias("left_factor"), right.alias("right_factor"))


@query(f"{REQUESTS}, r as (select id, w, greatest(w - 512, 0)::bigint as last from rq) select id, array_to_string(list_sort(list_distinct(list_append(range(0, last + 1, 448), last))), ',') as starts, greatest(25, ceil((w + 3) / 8.0) * 8 + 1)::bigint as padded from r")
def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array_sort(G.tile_starts(F.col("w"), 512, 64))
    return requests(spark, sf_dir).select("id", F.array_join(starts.cast("array<string>"), ",").alias("starts"), G.padded_count(F.col("w")).alias("padded"))


@query(f"{REQUESTS} select id, greatest(0, least(round_even(size * 37.5 - 128, 0), w - 256))::bigint as x0, greatest(0, least(round_even(size * 20.5 - 128, 0), h - 256))::bigint as y0 from rq")
def bounded_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = G.bounded_square(F.col("size") * 37.5, F.col("size") * 20.5, F.lit(256), F.col("w"), F.col("h"))
    return requests(spark, sf_dir).select("id", x0.alias("x0"), y0.alias("y0"))


PLAN = """
  a as (select *, case when mode = 'source' then 0 else mode::bigint end as box from rq),
  b as (select *, case when h > w then box else box * 16 // 9 end as bw, case when h > w then box * 16 // 9 else box end as bh from a),
  c as (select *, case when bw * h <= bh * w then bw else bh end as num, case when bw * h <= bh * w then w else h end as den from b),
  d as (select *, case when mode = 'source' or num >= den then w else floor(w * num / den::double / 2)::bigint * 2 end as fw, case when mode = 'source' or num >= den then h else floor(h * num / den::double / 2)::bigint * 2 end as fh from c),
  e as (select *, case when cap > 0 and fw > cap then cap + cap % 2 else fw end as iw, case when cap > 0 and fw > cap then floor((cap + cap % 2) * fh / fw::double)::bigint + floor((cap + cap % 2) * fh / fw::double)::bigint % 2 else fh end as ih from d),
  f as (select *, floor(abs(ipd) * greatest(iw, ih) / 100.0)::bigint as p0 from e),
  g as (select *, iw + 3 * (p0 - p0 % 2) as eye_w, ih as eye_h from f),
  o as (select *, case packing when 'full-sbs' then eye_w * 2 when 'half-sbs' then eye_w // 2 * 2 else eye_w end as out_w, case packing when 'full-ou' then eye_h * 2 when 'half-ou' then eye_h // 2 * 2 else eye_h end as out_h from g)
  select id, eye_w, eye_h, out_w, out_h, array_to_string(list_filter([case when out_w % 2 <> 0 or out_h % 2 <> 0 then 'odd' end, case when out_w > case when codec = 'h264' then 4096 else 8192 end then 'wide' end, case when out_h > case when codec = 'h264' then 4096 else 8192 end then 'high' end, case when least(eye_w, eye_h) < 64 then 'small' end], lambda x: x is not null), ',') as errors from o"""
GRID = """with s as (select * from (values (3840, 1632), (5082, 2160), (4096, 2160), (4098, 2160), (1920, 1080), (1080, 1920), (640, 360)) as s(w, h)),
  m as (select unnest(['source', '720', '1080', '1440', '2160', '4320']) as mode), l as (select unnest(['full-sbs', 'half-sbs', 'full-ou', 'half-ou']) as packing),
  k as (select * from (values (0, 0, 'h265'), (1024, 0, 'h264'), (0, 10, 'h265')) as k(cap, ipd, codec)),
  rq as (select w::varchar || 'x' || h || '/' || mode || '/' || packing || '/' || cap || '/' || ipd as id, * from s, m, l, k),"""


@query(GRID + PLAN)
def geometry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preflight of every combination of 7 sizes, 6 modes, 4 packings and 3 settings."""
    explode = lambda df, name, values: df.withColumn(name, F.explode(F.array(*values)))
    sizes = [F.struct(F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h")) for w, h in ((3840, 1632), (5082, 2160), (4096, 2160), (4098, 2160), (1920, 1080), (1080, 1920), (640, 360))]
    rest = [F.struct(F.lit(c).cast("long").alias("cap"), F.lit(i).cast("long").alias("ipd"), F.lit(k).alias("codec")) for c, i, k in ((0, 0, "h265"), (1024, 0, "h264"), (0, 10, "h265"))]
    df = explode(spark.range(1), "s", sizes)
    for name, values in (("mode", ["source", "720", "1080", "1440", "2160", "4320"]), ("packing", ["full-sbs", "half-sbs", "full-ou", "half-ou"])):
        df = explode(df, name, map(F.lit, values))
    df = explode(df, "k", rest).select("s.*", "mode", "packing", "k.*")
    id_ = F.concat(F.concat_ws("x", "w", "h"), F.lit("/"), F.concat_ws("/", "mode", "packing", F.col("cap").cast("string"), F.col("ipd").cast("string")))
    return G.plan(df).select(id_.alias("id"), "eye_w", "eye_h", "out_w", "out_h", F.array_join("errors", ",").alias("errors"))


@query(REQUESTS + """, lim as (select id, w * h * 3 * 240 as planned, least(6e9, greatest(1e9, 0.25 * size * 1e9)) as budget from rq)
  select id, planned <= budget as in_memory, [2, 4, 8, 16, 24][(id % 5 + 1)::int] as chunk, case id % 3 when 0 then 0.5 when 1 then 0.667 else 1.0 end::double as scale, case when size * 600 >= 12000 then 'large' else 'small' end as variant from lim join rq using (id)""")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport budget, values picked from lists by tier, presets and variants."""
    budget = F.least(F.lit(6e9), F.greatest(F.lit(1e9), 0.25 * F.col("size") * 1e9))
    chunk = F.element_at(F.array(*map(F.lit, (2, 4, 8, 16, 24))), (F.col("id") % 5 + 1).cast("int"))
    scale = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, 0.667).otherwise(1.0)
    return requests(spark, sf_dir).select("id", (F.col("w") * F.col("h") * 3 * 240 <= budget).alias("in_memory"), chunk.alias("chunk"), scale.alias("scale"), F.when(F.col("size") * 600 >= 12000, "large").otherwise("small").alias("variant"))


@query(REQUESTS + """ select id, round(x, 5) as x, round(y, 5) as y from (select id, (i + 0.5) / 4 as x, (j + 0.5) / 4 as y from (select id from rq), range(4) t(i), range(4) u(j))""")
def coordinate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised cell centres of a 4 x 4 grid for each request."""
    r = requests(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return r.select("id", F.round((F.col("i") + 0.5) / 4, 5).alias("x"), F.round((F.col("j") + 0.5) / 4, 5).alias("y"))


@query(REQUESTS + """, c as (select id, w * h / 1e6 as mp, size from rq) select id, round((mp * 0.8 + 2.5) * case when size > 25 then 1.4 else 1 end / greatest(0.25, size / 50.0), 6) as seconds from c""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic estimate of seconds from size and tier."""
    seconds = (F.col("w") * F.col("h") / 1e6 * 0.8 + 2.5) * F.when(F.col("size") > 25, 1.4).otherwise(1.0) / F.greatest(F.lit(0.25), F.col("size") / 50.0)
    return requests(spark, sf_dir).select("id", F.round(seconds, 6).alias("seconds"))


@query(REQUESTS + """ select id, unnest(case when size > 40 then ['model', 'weights', 'video'] when size > 20 then ['model', 'weights'] else ['model'] end) as path from rq""")
def model_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = F.when(F.col("size") > 40, F.array(*map(F.lit, ("model", "weights", "video")))).when(F.col("size") > 20, F.array(*map(F.lit, ("model", "weights")))).otherwise(F.array(F.lit("model")))
    return requests(spark, sf_dir).select("id", F.explode(needed).alias("path"))
