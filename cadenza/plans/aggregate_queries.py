"""Queries that aggregate: chunk and run results, splats, statistics, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import aggregates as A
from cadenza.operators import sequences as S
from cadenza.operators import splat as P
from cadenza.operators.select import grid_of

from .registry import CELLS, TIMELINE, cells, lagged_cells, query, table, timeline
from .sequence_queries import CUT, SCENES, scenes

CHUNKS = f"""{SCENES}, ch as (select session, frame // 16 as chunk, count(*) as frames, sum((frame % 4 = 0)::int)::bigint as refreshed, sum(coalesce(delta >= {CUT}, false)::int)::bigint as cuts,
  sum((confidence < 0.1)::int)::double / greatest(1, count(confidence)) as low_confidence, coalesce(avg(case when frame % 4 = 0 then delta end), 0.0) as mean_delta, coalesce(stddev_pop(value), 0.0) as scale_deviation from sc group by session, frame // 16)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenes(spark, sf_dir).select("session", F.floor(F.col("frame") / 16).alias("chunk"), (F.col("frame") % 4 == 0).alias("refresh"), F.coalesce(F.col("delta") >= CUT, F.lit(False)).alias("cut"), "confidence", "delta", F.col("value").alias("scale"))
    return A.chunk_results(rows, ["session", "chunk"])


@query(f"{CHUNKS} select session, chunk, frames, refreshed, cuts, round(low_confidence, 6) as low_confidence, round(mean_delta, 6) as mean_delta, round(scale_deviation, 6) as scale_deviation from ch")
def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("low_confidence", "mean_delta", "scale_deviation")})


@query(f"{CHUNKS} select session, count(*) as chunks, sum(frames)::bigint as frames, sum(cuts)::bigint as cuts, round(sum(low_confidence * frames) / sum(frames), 6) as low_confidence, round(max(scale_deviation), 6) as largest_deviation from ch group by session")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_results(_chunks(spark, sf_dir), ["session"]).withColumns({c: F.round(c, 6) for c in ("low_confidence", "largest_deviation")})


_LAYER = "round_even(l_discount * 100 / 10 * 11, 0) / 11"


@query(f"""with s as (select l_partkey + l_tax * 10 as pos, {_LAYER} as layer, l_extendedprice as colour from lineitem),
  t as (select floor(pos)::bigint as target, layer, 1 - (pos - floor(pos)) as weight, colour from s union all select floor(pos)::bigint + 1, layer, pos - floor(pos), colour from s),
  u as (select *, max(layer) over (partition by target) as front, min(layer) over (partition by target) as back from t where weight > 1e-4)
  select target, round(max(front), 6) as front, sum((layer >= front - 0.05)::int)::bigint as hits, round(sum(weight) filter (layer >= front - 0.05), 5) as coverage,
    round(sum(weight * colour) filter (layer >= front - 0.05) / sum(weight) filter (layer >= front - 0.05) + 1e-6, 3) as near, round(sum(weight * colour) filter (layer <= back + 0.05) / sum(weight) filter (layer <= back + 0.05) + 1e-6, 3) as far, sum(weight) filter (layer >= front - 0.05) >= 0.02 as valid from u group by target""")
def visibility_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sources: part and tax make the position, discount the layer, price the colour."""
    layer = F.rint(F.col("l_discount") * 100 / 10 * 11) / 11
    s = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_tax") * 10).alias("pos"), layer.alias("layer"), F.col("l_extendedprice").alias("colour"))
    rows = s.select("layer", "colour", F.explode(P.taps(F.col("pos"))).alias("t")).select("layer", "colour", "t.target", "t.weight")
    out = P.splat(rows, 0.05)
    return out.select("target", F.round("front", 6).alias("front"), "hits", F.round("coverage", 5).alias("coverage"), F.round(F.col("near") + 1e-6, 3).alias("near"), F.round(F.col("far") + 1e-6, 3).alias("far"), "valid")


@query("select l_partkey % 500 as pixel, count(*) as tiles, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1e-4), 4) as value from lineitem group by l_partkey % 500")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("pixel", F.col("l_partkey") % 500)
    return P.overlap_add(rows, ["pixel"], "l_extendedprice", "l_quantity").withColumn("value", F.round("value", 4))


@query(f"{TIMELINE} select kind, round(quantile_cont(value, 0.02), 6) as q02, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.98), 6) as q98, round(quantile_cont(case when frame % 4 = 0 then value end, 0.5), 6) as q50_strided from tl group by kind")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("kind", "value", "frame")
    q = lambda p: F.round(A.interpolated("value", p), 6)
    every = A.ranked(t, ["kind"], "value").groupBy("kind").agg(q(0.02).alias("q02"), q(0.5).alias("q50"), q(0.98).alias("q98"))
    strided = A.ranked(t.where("frame % 4 = 0"), ["kind"], "value").groupBy("kind").agg(q(0.5).alias("q50_strided"))
    return every.join(strided, "kind", "left")


@query(f"{CELLS}, m as (select frame, scene, y, x, v, lag(v) over (partition by scene, y, x order by frame) as was from cl) select frame, round(avg(abs(v - was)) / 255, 8) as mae from m where was is not null group by frame")
def scene_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lagged_cells(spark, sf_dir)
    return m.groupBy("frame").agg(F.round(F.avg(F.abs(F.col("v") - F.col("was"))) / 255, 8).alias("mae"))


@query(f"{CELLS}, f as (select frame, scene, sum((v < 0)::int) as mask, sum((v < -0.1)::int) as made from cl group by frame, scene) select scene, round(avg(1 - made::double / greatest(1, mask)), 6) as mean_coverage, round(sum(made)::double / greatest(1, sum(mask)), 6) as residual, sum(mask)::bigint as mask from f group by scene")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cells(spark, sf_dir).groupBy("frame", "scene").agg(F.count_if(F.col("v") < 0).alias("mask"), F.count_if(F.col("v") < -0.1).alias("made"))
    share = F.col("made") / F.greatest(F.lit(1), F.col("mask"))
    return f.groupBy("scene").agg(F.round(F.avg(1 - share), 6).alias("mean_coverage"), F.round(F.sum("made") / F.greatest(F.lit(1), F.sum("mask")), 6).alias("residual"), F.sum("mask").alias("mask"))


@query("select l_orderkey % 100 as frame, count(distinct l_partkey) as pixels, count(distinct case when l_returnflag = 'R' then l_partkey end) as reused, round(100.0 * count(distinct case when l_returnflag = 'R' then l_partkey end) / greatest(1, count(distinct l_partkey)), 4) as percent from lineitem group by l_orderkey % 100")
def roi_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of unique pixels."""
    pixels, reused = F.count_distinct("l_partkey"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("frame")).agg(pixels.alias("pixels"), reused.alias("reused"), F.round(100.0 * reused / F.greatest(F.lit(1), pixels), 4).alias("percent"))


@query(f"{TIMELINE} select session, round(sum(value) filter (kind = 'view'), 4) as reconstruct, round(sum(value) filter (kind = 'click'), 4) as encode, round(greatest(0, coalesce(sum(value) filter (kind = 'view'), 0) - coalesce(sum(value) filter (kind = 'click'), 0)), 4) as exclusive from tl group by session")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time by phase, and one phase's time without the other's that it holds."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")))
    exclusive = F.greatest(F.lit(0.0), F.coalesce(of("view"), F.lit(0.0)) - F.coalesce(of("click"), F.lit(0.0)))
    return timeline(spark, sf_dir).groupBy("session").agg(F.round(of("view"), 4).alias("reconstruct"), F.round(of("click"), 4).alias("encode"), F.round(exclusive, 4).alias("exclusive"))


@query("select coalesce(p_brand, 'all') as folder, count(*) as files, round(sum(p_retailprice) / 1024, 3) as kib from part group by rollup (p_brand)")
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and counts by folder, with a grand total from the same pass."""
    p = table(spark, sf_dir, "part").rollup("p_brand").agg(F.count("*").alias("files"), F.round(F.sum("p_retailprice") / 1024, 3).alias("kib"))
    return p.select(F.coalesce("p_brand", F.lit("all")).alias("folder"), "files", "kib")


@query("select count(*) as files, sum(n_chars)::bigint as size, max(sha256(text)) as last_digest from documents")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.max(F.sha2("text", 256)).alias("last_digest"))


@query(f"{TIMELINE}, s as (select session, median(value) as median, list(value order by value) as v from tl group by session) select session, round(median, 6) as median, v[greatest(1, floor(len(v) * 0.95))::int] as p95, round(1000 / median, 6) as fps from s")
def benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, nearest-rank p95 and frames per second of a run's samples."""
    r = A.ranked(timeline(spark, sf_dir), ["session"], "value")
    s = r.groupBy("session").agg(A.interpolated("value", 0.5).alias("m"), A.nearest_rank("value", 0.95).alias("p95"))
    return s.select("session", F.round("m", 6).alias("median"), "p95", F.round(1000 / F.col("m"), 6).alias("fps"))


@query(f"{TIMELINE}, d as (select session, value - lag(value) over (partition by session order by frame) as drift, value as fps, t from tl) select session, round(max(abs(drift)), 6) as largest_drift, round(avg(fps), 6) as mean_fps, min(fps) as least_fps, count(*) as samples, count(*) >= 4 as enough from d where t >= 2 group by session")
def steady_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and rates without the first two seconds."""
    d = timeline(spark, sf_dir).withColumn("drift", F.col("value") - F.lag("value").over(S.ordered("session"))).where("t >= 2")
    return d.groupBy("session").agg(F.round(F.max(F.abs("drift")), 6).alias("largest_drift"), F.round(F.avg("value"), 6).alias("mean_fps"), F.min("value").alias("least_fps"), F.count("*").alias("samples"), (F.count("*") >= 4).alias("enough"))


@query("""with r as (select p_partkey, p_size::double as a, (p_partkey % 7) * 5.0::double as b, (p_partkey % 5) * 10.0::double as c from part),
  o as (select *, case when a > 0 and b > 0 then least(a, b) else greatest(a, b) end as over_ from r)
  select p_partkey, round(case when over_ > 0 and c > 0 then 1 / (1 / over_ + 1 / c) else 0 end, 6) as fps from o""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("p_size").cast("double"), (F.col("p_partkey") % 7) * 5.0, (F.col("p_partkey") % 5) * 10.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(A.combined_rate([c], [a, b]), 6).alias("fps"))


@query(f"""{CELLS}, m as materialized (select frame, y, x, y * 8 + x as own from cl where v > 0.1), l as (with recursive r as (
    select frame, y, x, own as least from m union
    select m.frame, m.y, m.x, r.least from r join m on m.frame = r.frame and abs(m.y - r.y) <= 1 and abs(m.x - r.x) <= 1 and r.least < m.own) select frame, y, x, min(least) as least from r group by all)
  select frame, (dense_rank() over (partition by frame order by least) - 1)::int as label, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*)::int as area, avg(x) as cx, avg(y) as cy from l group by frame, least""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected components of each grid's cells over .1: bounds, area and centre."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches):
        for batch in batches:
            rows = []
            for frame, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for label, (ys, xs) in enumerate(components(grid_of(values) > 0.1)):
                    rows.append((frame, label, int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()), len(xs), float(xs.mean()), float(ys.mean())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.int32()] * 6, *[pa.float64()] * 2], strict=True)], ["frame", "label", "x0", "y0", "x1", "y1", "area", "cx", "cy"])

    return e.mapInArrow(run, "frame long, label int, x0 int, y0 int, x1 int, y1 int, area int, cx double, cy double")


def components(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells (ys, xs) of each 8-connected component, by spreading the least label."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, 1, constant_values=0)
        around = np.stack([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(mask, np.where(around > 0, around, h * w + 1).min(axis=0), 0)
        if (new == label).all():
            return [np.nonzero(label == i) for i in np.unique(label[mask])]
        label = new


REASON = """case when k < 18 then 'few-matches' when value < 16 then 'few-inliers' when frame % 9 = 0 then 'narrow-coverage' when confidence < 0.7 then 'low-confidence' else 'ok' end"""


@query(f"{TIMELINE}, r as (select {REASON} as reason from tl) select reason, count(*) as links from r group by reason")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the first reason that rejects them."""
    reason = F.when(F.col("k") < 18, "few-matches").when(F.col("value") < 16, "few-inliers").when(F.col("frame") % 9 == 0, "narrow-coverage").when(F.col("confidence") < 0.7, "low-confidence").otherwise("ok")
    return timeline(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("links"))


@query("select p_type, count(*) as files, round(sum(p_retailprice), 4) as bytes from part group by p_type")
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("files"), F.round(F.sum("p_retailprice"), 4).alias("bytes"))


@query(f"""{TIMELINE}, n as (select session, count(*) as n from tl group by session), l as (
    select a.session, b.frame - a.frame as lag, sum(a.value * b.confidence) / nullif(sqrt(sum(a.value * a.value) * sum(b.confidence * b.confidence)), 0) as s
    from tl a join tl b on a.session = b.session and b.frame - a.frame between -640 and 640 join n on a.session = n.session group by a.session, b.frame - a.frame, n.n having 2 * count(*) >= n.n)
  select session, arg_max(lag, (round(s, 6), -abs(lag), -lag)) as best_lag, round(max(s), 6) as best, round(max(s) filter (lag = 0), 6) as zero_lag from l group by session""")
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag within 640 frames at which two series agree best.

    Agreement is the product over the overlap, by the norms of both there. An overlap of under half a session counts
    for nothing: that of a single frame would always agree. Of equals, the lag nearest to zero.
    """
    t = timeline(spark, sf_dir)
    sums = A.lag_sums(t.select("session", "frame", F.col("value").alias("a"), F.col("confidence").alias("b")), 640)
    n = F.max("overlap").over(Window.partitionBy("session"))  # at lag 0 all frames meet
    norm = F.sqrt(F.col("aa") * F.col("bb"))
    s = sums.withColumn("n", n).where("2 * overlap >= n").withColumn("s", F.col("ab") / F.nullif(norm, F.lit(0.0)))
    best = F.max_by("lag", F.struct(F.round("s", 6), -F.abs("lag"), -F.col("lag")))
    return s.groupBy("session").agg(best.alias("best_lag"), F.round(F.max("s"), 6).alias("best"), F.round(F.max(F.when(F.col("lag") == 0, F.col("s"))), 6).alias("zero_lag"))


@query(f"{TIMELINE}, o as (select session, frame, value, k - 50 as off, k >= lag(k) over (partition by session order by frame) as up from tl) select session, round(avg(value), 6) as mean_error, round_even(median(off), 0)::bigint as median_offset, sum((abs(off) <= 1)::int)::bigint as within_one, bool_and(coalesce(up, true)) as monotonic from o group by session")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = timeline(spark, sf_dir).withColumn("off", F.col("k") - 50).withColumn("up", F.coalesce(F.col("k") >= F.lag("k").over(S.ordered("session")), F.lit(True)))
    sums = o.groupBy("session").agg(F.round(F.avg("value"), 6).alias("mean_error"), F.count_if(F.abs("off") <= 1).alias("within_one"), F.bool_and("up").alias("monotonic"))
    medians = A.ranked(o, ["session"], "off").groupBy("session").agg(F.bround(A.interpolated("off", 0.5)).cast("long").alias("median_offset"))
    return sums.join(medians, "session", "left")


@query("select p_partkey % 20 as chunk, count(*) as frames, round(sum(p_retailprice) / 1000, 6) as elapsed, round(count(*) / (sum(p_retailprice) / 1000), 6) as fps, max(p_size) as peak from part group by p_partkey % 20")
def chunk_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.sum("p_retailprice") / 1000
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 20).alias("chunk")).agg(F.count("*").alias("frames"), F.round(seconds, 6).alias("elapsed"), F.round(F.count("*") / seconds, 6).alias("fps"), F.max("p_size").alias("peak"))
