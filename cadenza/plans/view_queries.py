"""Warped and repaired views of grids, a trimmed range over time, and round trips through a sidecar and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import fields
from cadenza.operators import grids as G
from cadenza.operators import sequences as S
from cadenza.sources import chunks, sidecars
from cadenza.sources.shared import new_folder
from cadenza.streaming.stateful import folded, silent, state_store

from .registry import CELLS, ORACLES, cells, lagged_cells, query, table, whole_grids
from .sequence_queries import CUT, scenes

_AT = """{0}_t as (select frame, y, x, least(7, floor(px)::int + ox) as sx, least(7, floor(py)::int + oy) as sy, abs(1 - ox - (px - floor(px))) * abs(1 - oy - (py - floor(py))) as w from {0}, range(2) a(ox), range(2) b(oy)),
  {0}_s as (select t.frame, t.y, t.x, sum(s.{1} * w) as sampled from {0}_t t join {0} s on s.frame = t.frame and s.y = t.sy and s.x = t.sx group by t.frame, t.y, t.x)"""


@query(f"""{CELLS}, h as (select *, lag(v) over (partition by scene, y, x order by frame) as was from cl), p as (select *, greatest(0, least(7, x + v * 2)) as px, greatest(0, least(7, y - v)) as py from h where was is not null), {_AT.format("p", "was")}
  select p.frame, p.y, p.x, round(v + (sampled - v) * 0.6 * least(1, abs(v) * 4), 6) as depth, x + v * 2 between 0 and 7 and y - v between 0 and 7 as inside from p join p_s using (frame, y, x)""")
def warped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame before, drawn along the flow to this one, and blended in by the flow's confidence."""
    h = lagged_cells(spark, sf_dir)
    px, py = F.col("x") + F.col("v") * 2, F.col("y") - F.col("v")
    warped = G.sampled(h.withColumns({"px": px, "py": py}), h.select("frame", "y", "x", F.col("was").alias("v")), 8, 8, "warped")
    share = 0.6 * F.least(F.lit(1.0), F.abs("v") * 4)
    both = h.join(warped, ["frame", "y", "x"])
    return both.select("frame", "y", "x", F.round(F.col("v") + (F.col("warped") - F.col("v")) * share, 6).alias("depth"), (px.between(0, 7) & py.between(0, 7)).alias("inside"))


@query(f"""{CELLS}, p as (select *, greatest(0, least(7, x + v * 4)) as px, y as py from cl), {_AT.format("p", "v")}
  select p.frame, p.y, p.x, round(case when x + v * 4 between 0 and 7 then sampled else v + (sampled - v) * 0.65 end, 6) as view from p join p_s using (frame, y, x)""")
def inverse_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view by backward sampling along its own disparity; where that leaves the grid, a share of the unwarped value."""
    c = cells(spark, sf_dir)
    px = F.col("x") + F.col("v") * 4
    both = c.join(G.sampled(c.withColumns({"px": px, "py": F.col("y")}), c, 8, 8, "s"), ["frame", "y", "x"])
    return both.select("frame", "y", "x", F.round(F.when(px.between(0, 7), F.col("s")).otherwise(F.col("v") + (F.col("s") - F.col("v")) * 0.65), 6).alias("view"))


@query(f"""{CELLS}, n as (select frame, yy as y, xx as x, greatest(0, least(7, (xx + 0.5) * (8 / 5::double) - 0.5)) as px, greatest(0, least(7, (yy + 0.5) * (8 / 3::double) - 0.5)) as py from (select distinct frame from cl), range(3) a(yy), range(5) b(xx)),
  t as (select frame, y, x, least(7, floor(px)::int + ox) as sx, least(7, floor(py)::int + oy) as sy, abs(1 - ox - (px - floor(px))) * abs(1 - oy - (py - floor(py))) as w from n, range(2) a(ox), range(2) b(oy))
  select t.frame, t.y::int as y, t.x::int as x, round(sum(v * w) * (5 / 8::double), 6) as flow from t join cl on cl.frame = t.frame and cl.y = t.sy and cl.x = t.sx group by t.frame, t.y, t.x""")
def resized_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow on a grid of 5 x 3."""
    grids = whole_grids(spark, sf_dir).select("frame", fields.summed(lambda v: v).alias("v"))
    return fields.resized_flow(grids, 8, 8, 3, 5).select("frame", "y", "x", F.round("v", 6).alias("flow"))


def _splatted(source: str, n: str = "") -> str:
    return f"""s{n} as (select frame, y, x + v * 4 as pos, round_even(v * 5, 0) / 5 as layer, v as colour from {source}),
  t{n} as (select frame, y, floor(pos)::int as x, 1 - (pos - floor(pos)) as weight, layer, colour from s{n} union all select frame, y, floor(pos)::int + 1, pos - floor(pos), layer, colour from s{n}),
  u{n} as (select *, max(layer) over (partition by frame, y, x) as front, min(layer) over (partition by frame, y, x) as back from t{n} where weight > 1e-4 and x between 0 and 7),
  g{n} as (select frame, y, x, sum(weight * colour) filter (layer >= front - 0.05) / sum(weight) filter (layer >= front - 0.05) as near, sum(weight) filter (layer >= front - 0.05) >= 0.02 as valid, max(front) - 0.05 > min(back) as crossed from u{n} group by frame, y, x),
  seen{n} as (select c.frame, c.y, c.x, v, near, coalesce(valid, false) as valid, coalesce(crossed, false) as crossed from {source} c left join g{n} using (frame, y, x))"""


#: Rows (frame, y, x, v, near, valid, crossed): what a forward splat by 4 * v leaves, in six layers.
_SEEN = f"{CELLS}, {_splatted('cl')}"


def _over(f: str, value: str, ry: int, rx: int, source: str, name: str) -> str:
    return f"{name}_r as (select *, {f}({value}) over (partition by frame, y order by x rows between {rx} preceding and {rx} following) as s_ from {source}), {name}_t as (select * exclude (s_), {f}(s_) over (partition by frame, x order by y rows between {ry} preceding and {ry} following) as {name} from {name}_r)"


#: The same with hole, joined, c1 and c2, of which the bands are made.
_MASKS = f"""{_SEEN}, h as (select *, (not valid)::int as hole from seen), {_over("sum", "hole", 1, 1, "h", "n9")}, {_over("max", "(n9 / 9 >= 0.22)::int", 2, 1, "n9_t", "wide")}, {_over("sum", "wide", 2, 1, "wide_t", "n15")},
  j as (select *, (n15 / 15 >= 0.52)::int as joined from n15_t), {_over("max", "joined", 2, 4, "j", "c1")}, {_over("max", "joined", 3, 3, "c1_t", "c2")}"""


@query(f"""{_MASKS}
  select frame, y, x, hole = 1 as hole, c1 > 0 or (crossed and c2 > 0) as context, joined = 1 and (c1 > 0 or (crossed and c2 > 0)) as compose from c2_t""")
def stereo_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where another view has holes: a forward splat of each grid, its uncovered cells, and smooth bands about them."""
    seen = G.visible(cells(spark, sf_dir), F.col("v") * 4, 6, 8).withColumn("hole", ~F.col("valid"))
    return G.visibility_masks(seen).select("frame", "y", "x", "hole", "context", "compose")


_NEAREST = "coalesce(last_value(case when valid then {0} end ignore nulls) over l, first_value(case when valid then {0} end ignore nulls) over r, {1})"


@query(f"""{_MASKS}, m as (select frame, y, x, v, near, valid, joined = 1 and (c1 > 0 or (crossed and c2 > 0)) as compose from c2_t),
  e as (select *, {_NEAREST.format("near", "0")} as d, {_NEAREST.format("x", "x")} as edge from m window l as (partition by frame, y order by x rows unbounded preceding), r as (partition by frame, y order by x rows between current row and unbounded following)),
  p as (select *, greatest(0, least(7, x - d * 4)) as px, y as py from e), {_AT.format("p", "v")},
  b as (select p.*, sampled as back, greatest(0, least(7, edge - 2 - greatest(0, x - edge - 1))) as src from p join p_s using (frame, y, x)),
  f as (select b.*, case when b.compose and not b.valid then s.back else b.back end as seed from b join b s on s.frame = b.frame and s.y = b.y and s.x = b.src), {_over("sum", "seed", 2, 0, "f", "v5")},
  g2 as (select *, case when compose then seed + (v5 / 5 - seed) * 0.15 else seed end as soft from v5_t), {_over("sum", "soft", 1, 1, "g2", "s9")}
  select frame, y, x, round(case when compose then greatest(-1, least(1, soft + (soft - s9 / 9) * 0.35 * 0.5)) else soft end, 6) as view, compose from s9_t""")
def backward_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility by a splat, colour by sampling back along the disparity that it leaves; reveals mirror what lies beside them."""
    seen = G.visible(cells(spark, sf_dir), F.col("v") * 4, 6, 8)
    return G.backward_view(seen, 8, 8, 4.0).select("frame", "y", "x", F.round("view", 6).alias("view"), "compose")


_ROW = "partition by frame, y order by x rows between {0} preceding and {0} following"


@query(f"""{_SEEN}, a as (select *, case when valid then near end as f0 from seen), b as (select *, coalesce(f0, avg(f0) over ({_ROW.format(1)})) as f1 from a), c as (select *, coalesce(f1, avg(f1) over ({_ROW.format(2)})) as f2 from b), d as (select *, coalesce(f2, avg(f2) over ({_ROW.format(4)})) as f3 from c)
  select frame, y, x, round(case when valid then near else v + (coalesce(f3, v) - v) * 0.8 end, 6) as view, valid from d""")
def layered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward splat that keeps the foreground, with its holes filled from known cells in the row, by a strength."""
    seen = G.by_frame(G.visible(cells(spark, sf_dir), F.col("v") * 4, 6, 8)).withColumnRenamed("v", "own").withColumn("v", F.col("near"))
    filled = G.push_pull(seen, F.col("valid"), (1, 2, 4))
    view = F.when(F.col("valid"), F.col("near")).otherwise(F.col("own") + (F.coalesce("f", "own") - F.col("own")) * 0.8)
    return filled.select("frame", "y", "x", F.round(view, 6).alias("view"), "valid")


@query(f"""{_SEEN}, pl as (select frame, y, x, min(v) over ({_ROW.format(2)}) as v from cl), {_splatted("pl", "2")},
  a as (select seen.*, case when seen.valid then seen.near when seen2.valid then seen2.near end as f0, seen.valid or seen2.valid as known from seen join seen2 on seen.frame = seen2.frame and seen.y = seen2.y and seen.x = seen2.x),
  b as (select *, coalesce(f0, avg(f0) over ({_ROW.format(1)})) as f1 from a), c as (select *, coalesce(f1, avg(f1) over ({_ROW.format(2)})) as f2 from b), d as (select *, coalesce(f2, avg(f2) over ({_ROW.format(4)})) as f3 from c),
  w as (select *, case when known then f0 else v + (coalesce(f3, v) - v) * 0.8 end as soft from d), {_over("sum", "soft", 1, 1, "w", "s9")}
  select frame, y, x, round(case when valid then soft else greatest(-1, least(1, soft + (soft - s9 / 9) * 0.65 * 0.5)) end, 6) as view, not valid as hole, known from s9_t""")
def plated_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward splat whose holes show the splat of a far plate, or else known cells of the row."""
    return G.plated_view(cells(spark, sf_dir), 4.0, 6, 8).select("frame", "y", "x", F.round("view", 6).alias("view"), "hole", "known")


@query(f"""{CELLS}, q as (select scene, frame, quantile_cont(v, 0.05) as a, quantile_cont(v, 0.95) as b from cl where y % 2 = 0 and x % 2 = 0 group by scene, frame),
  r as materialized (select scene, frame, case when b - a < 1e-4 then 0 else a end as a, case when b - a < 1e-4 then 1 else b end as b, row_number() over (partition by scene order by frame) as i from q), e as (with recursive f as (
    select scene, frame, i, a, b from r where i = 1 union all
    select r.scene, r.frame, r.i, r.a * (1 - 0.9) + f.a * 0.9, r.b * (1 - 0.9) + f.b * 0.9 from r join f on r.scene is not distinct from f.scene and r.i = f.i + 1) select * from f)
  select frame, round(a, 6) as low, round(b, 6) as high from e""")
def trimmed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of every other cell between the .05 and .95 quantiles, smoothed over a scene's frames; (0, 1) where it is flat."""
    some = cells(spark, sf_dir).where("y % 2 = 0 and x % 2 = 0")
    q = some.groupBy("scene", "frame").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    flat = F.col("q")[1] - F.col("q")[0] < 1e-4
    ends = q.select("scene", "frame", F.when(flat, 0.0).otherwise(F.col("q")[0]).alias("a"), F.when(flat, 1.0).otherwise(F.col("q")[1]).alias("b"))
    out = S.ema(ends, ["scene"], ["a", "b"], ["low", "high"], 0.9, ["frame"])
    return out.select("frame", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("select vec_id as frame, vec_id % 50 = 0 as cut, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings")
def vrd_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids written as raw sidecars, a file per range of frames, and read back."""
    sidecars.register(spark)
    path = new_folder(spark)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), (F.col("vec_id") % 50 == 0).alias("cut"), F.lit("max").alias("mode"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<float>").alias("values"))
    e.repartitionByRange("frame").write.format("vrd").mode("append").save(path)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.format("vrd").load(path).select("frame", "cut", F.round(total, 4).alias("total"))


@query(ORACLES["refresh_schedule"])
def streamed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh schedule as a stream: sessions in files, a state per session, all that is there in micro-batches."""
    path = new_folder(spark)
    rows = scenes(spark, sf_dir).select("session", "frame", F.coalesce(F.col("delta") >= CUT, F.lit(False)).alias("cut"), "confidence", F.col("value").alias("motion"))
    rows.repartition("session").write.parquet(f"{path}/in")  # a session's frames come in one file
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    out = folded(stream, lambda: S.NEVER, S.refresh_step(8, 3, 0.1, 90.0), "refresh boolean, since long", ["session", "frame"], "since long")
    with state_store(spark):
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("""select vec_id as frame, vec_id % 50 = 0 as cut, round(list_sum(list_transform(embedding, lambda x: 2 * x::double)), 4) as total, floor(embedding[1] * 16) / 16 as dx, vec_id % 3 > 0 as valid from embeddings""")
def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids and their motion as numbered chunks, read as a stream that consumes them, doubled, and published as chunks by a stream."""
    chunks.register(spark)
    path = new_folder(spark)
    record = F.struct((F.floor(F.col("embedding")[0] * 16) / 16).cast("float").alias("dx"), F.lit(0.0).cast("float").alias("dy"), (F.col("vec_id") % 3 > 0).alias("valid"), F.lit(255).cast("smallint").alias("confidence"))
    whole = lambda v, name: F.lit(v).alias(name)
    motion = F.struct(whole(3, "version"), whole(8, "width"), whole(8, "height"), whole(8, "tile"), whole(1, "tiles_x"), whole(1, "tiles_y"), F.lit(False).alias("reset"), F.array(record).alias("records"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), (F.col("vec_id") % 50 == 0).alias("cut"), whole("max", "mode"), whole(8, "height"), whole(8, "width"), F.col("embedding").cast("array<float>").alias("values"), motion.alias("motion"))
    e.repartitionByRange("frame").sortWithinPartitions("frame").write.format("chunks").mode("append").option("chunk", 256).save(f"{path}/in")
    stream = spark.readStream.format("chunks").option("path", f"{path}/in").option("motion", "required").load()
    doubled = stream.select("frame", "cut", "mode", "height", "width", F.transform("values", lambda v: v * 2).alias("values"), "motion")
    doubled.writeStream.format("chunks").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    first = F.col("motion.records")[0]
    return spark.read.format("chunks").load(f"{path}/out").select("frame", "cut", F.round(total, 4).alias("total"), first["dx"].cast("double").alias("dx"), first["valid"].alias("valid"))


#: Milliseconds: a pause of a session that is an alarm, and how far the watermark stays behind.
_IDLE, _LATE = 86_400_000, 3_600_000


@query(f"""with e as (select user_id as session, epoch_ms(ts) as ms, lead(epoch_ms(ts)) over (partition by user_id order by ts) as after, (select max(epoch_ms(ts)) from events) - {_LATE} as mark from events),
  p as (select *, coalesce(after - ms > {_IDLE}, ms + {_IDLE} < mark) as alarm, row_number() over (partition by session order by ms) as i from e),
  n as (select *, coalesce(max(i) filter (alarm) over (partition by session order by i rows between unbounded preceding and 1 preceding), 0) as last from p)
  select session, ms as since_ms, i - last as rows from n where alarm""")
def streamed_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of sessions that pause for over a day, also of those that never come back: state with event-time timers."""
    path = new_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"))
    rows.write.parquet(f"{path}/in")
    out = silent(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), _IDLE, "at", f"{_LATE // 1000} seconds")
    with state_store(spark):
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
