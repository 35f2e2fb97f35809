"""Queries on sequences: scenes, lags, folds, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import aggregates as A
from cadenza.operators import sequences as S

from .registry import CELLS, TIMELINE, cells, query, timeline

CUT = 60.0
SCENES = f"{TIMELINE}, d as (select *, abs(value - lag(value) over (partition by session order by frame)) as delta from tl), sc as (select *, sum(case when delta >= {CUT} then 1 else 0 end) over (partition by session order by frame rows unbounded preceding)::bigint as scene from d)"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_scene(timeline(spark, sf_dir).withColumn("delta", S.change("value")), F.col("delta") >= CUT)


@query(f"{SCENES} select session, scene, count(*) as frames, round(avg(value), 6) as mean_value, round(quantile_cont(value, 0.75), 6) as p75 from sc group by session, scene")
def scene_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = scenes(spark, sf_dir).groupBy("session", "scene")
    return grouped.agg(F.count("*").alias("frames"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.percentile("value", 0.75), 6).alias("p75"))


@query(f"{TIMELINE} select session, frame, value, lag(value) over w as previous, lag(frame) over w as previous_frame from tl window w as (partition by session order by frame)")
def previous_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.ordered("session")
    return timeline(spark, sf_dir).select("session", "frame", "value", F.lag("value").over(w).alias("previous"), F.lag("frame").over(w).alias("previous_frame"))


@query(f"{SCENES} select session, frame, scene, coalesce(delta >= {CUT}, false) as cut from sc")
def scene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(spark, sf_dir).select("session", "frame", "scene", F.coalesce(F.col("delta") >= CUT, F.lit(False)).alias("cut"))


@query(f"{TIMELINE} select session, frame, sum(case when confidence < 0.035 and frame > 0 then 1 else 0 end) over (partition by session order by frame rows unbounded preceding)::bigint as scene from tl")
def low_confidence_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_scene(timeline(spark, sf_dir), (F.col("confidence") < 0.035) & (F.col("frame") > 0)).select("session", "frame", "scene")


@query(f"{SCENES}, n as (select *, row_number() over (partition by session, scene order by frame) as i from sc) select session, frame, case when scene = 0 then i + 12 else i - 1 end as since_cut from n")
def frames_since_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.since_cut(scenes(spark, sf_dir), 12).select("session", "frame", "since_cut")


@query(f"{SCENES} select session, frame, last_value(case when frame % 4 = 0 then value end ignore nulls) over (partition by session, scene order by frame rows unbounded preceding) as held from sc")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("frame") % 4 == 0, F.col("value"))
    return S.carried(scenes(spark, sf_dir), value, "held", "session", "scene").select("session", "frame", "held")


@query(f"""{TIMELINE}, s as (select session, frame, round(t / 3600, 6) as t from tl), r as (
  select session, frame, t, count(*) over w as n, min(t) over w as t0, min(frame) over w as f0, max(frame) over w as f1 from s
  window w as (partition by session order by round(t * 1000000)::bigint range between 3000000 preceding and current row)), q as (
  select *, case when n >= 2 and t - t0 >= 0.25 then (f1 - f0) / (t - t0) when n < 2 and t > 0.25 then frame / t end as now from r)
  select session, frame, round(last_value(now ignore nulls) over (partition by session order by frame rows unbounded preceding), 6) as rate from q""")
def producer_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing rate, with hours in the place of seconds (the events are minutes apart)."""
    hours = timeline(spark, sf_dir).select("session", "frame", F.round(F.col("t") / 3600, 6).alias("t"))
    return S.trailing_rate(hours).select("session", "frame", F.round("rate", 6).alias("rate"))


_SIDES = "case when v > 0 then v end"


@query(f"""{CELLS} select frame, y, x,
  coalesce({_SIDES}, first_value({_SIDES} ignore nulls) over (partition by frame, y order by x rows between current row and unbounded following), last_value({_SIDES} ignore nulls) over (partition by frame, y order by x rows unbounded preceding)) as from_right,
  coalesce({_SIDES}, last_value({_SIDES} ignore nulls) over (partition by frame, y order by x rows unbounded preceding), first_value({_SIDES} ignore nulls) over (partition by frame, y order by x rows between current row and unbounded following)) as from_left from cl""")
def directional_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("v") > 0, F.col("v"))
    right, left = (S.filled(known, ["frame", "y"], "x", side) for side in (True, False))
    return cells(spark, sf_dir).select("frame", "y", "x", right.alias("from_right"), left.alias("from_left"))


@query(f"""{CELLS}, g as (select *, v <= 0 as hole,
    first_value(case when v > 0 then x end ignore nulls) over (partition by frame, y order by x rows between current row and unbounded following) as r from cl),
  s as (select *, case when hole and r is not null then least(7, r + (r - x)) else x end as src from g)
  select s.frame, s.y, s.x, s.src, c.v from s join cl c on c.frame = s.frame and c.y = s.y and c.x = s.src""")
def mirror_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflect what is right of a gap into it: the source lies as far behind the border as the cell before it."""
    c = cells(spark, sf_dir)
    right = F.first(F.when(F.col("v") > 0, F.col("x")), ignorenulls=True).over(Window.partitionBy("frame", "y").orderBy("x").rowsBetween(0, Window.unboundedFollowing))
    source = F.when((F.col("v") <= 0) & right.isNotNull(), F.least(F.lit(7), 2 * right - F.col("x"))).otherwise(F.col("x"))
    return c.select("frame", "y", "x", source.cast("int").alias("src")).join(c.select("frame", "y", F.col("x").alias("src"), "v"), ["frame", "y", "src"])


@query(f"""{CELLS}, h as (select frame, y, x, x - row_number() over (partition by frame, y order by x) as i from cl where v <= 0)
  select frame, y, min(x) as first, max(x) as last, count(*) as length from h group by frame, y, i""")
def hole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(cells(spark, sf_dir).where("v <= 0"), ["frame", "y"], "x")


@query(f"{TIMELINE} select session, frame, frame % 24 = 0 as forced from tl")
def periodic_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).select("session", "frame", (F.pmod("frame", F.lit(24)) == 0).alias("forced"))


@query(f"""{SCENES}, e as (select session, scene, min(frame) as f, max(frame) as l from sc group by session, scene), s as (select *, unnest(range(f, l + 1, 6)) as start from e),
  w as (select session, scene, f, l, start, least(6, l - start + 1) as outputs, o + 3 as place, greatest(f, least(l, start + o)) as frame from s, range(-3, 9) r(o))
  select w.session, w.scene, w.start, w.outputs, count(*) as context, round(avg(value), 6) as context_mean, round(avg(value) filter (place between 3 and outputs + 2), 6) as output_mean, min(w.frame) as first_context, max(w.frame) as last_context, greatest(any_value(f), w.start - 6) as first_donor, least(any_value(l), w.start + 11) as last_donor
  from w join sc on sc.session = w.session and sc.frame = w.frame group by w.session, w.scene, w.start, w.outputs""")
def owned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that own six frames each and see three more on either side, clamped to the scene; donors lie up to three farther."""
    rows = scenes(spark, sf_dir).select("session", "scene", "frame", "value")
    seen = S.owned_windows(rows, ["session", "scene"]).join(rows.select("session", "frame", "value"), ["session", "frame"])
    output = F.when(F.col("order").between(3, F.col("outputs") + 2), F.col("value"))
    out = seen.groupBy("session", "scene", "start", "outputs").agg(F.count("*").alias("context"), F.round(F.avg("value"), 6).alias("context_mean"), F.round(F.avg(output), 6).alias("output_mean"), F.min("frame").alias("first_context"), F.max("frame").alias("last_context"), F.first("first_donor").alias("first_donor"), F.first("last_donor").alias("last_donor"))
    return out


@query(f"{TIMELINE}, p as (select session, frame, t, 100.0::double * (frame + 1) / count(*) over (partition by session) as percent from tl) select session, frame, round(case when percent > 0.25 and percent < 100 then t * (100 - percent) / percent end + 1e-6, 4) as eta from p")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = 100.0 * (F.col("frame") + 1) / F.count("*").over(Window.partitionBy("session"))
    t = timeline(spark, sf_dir).withColumn("percent", percent)
    eta = F.when((F.col("percent") > 0.25) & (F.col("percent") < 100), F.col("t") * (100 - F.col("percent")) / F.col("percent"))
    return t.select("session", "frame", F.round(eta + 1e-6, 4).alias("eta"))


@query(f"{SCENES} select session, frame, min(frame) over w as first_context, max(frame) over w as last_context, count(*) over w as context, round(avg(value) over w, 6) as mean_value from sc window w as (partition by session, scene order by frame rows between 3 preceding and 8 following)")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 3 frames before and 8 after, clamped to the scene."""
    w = S.ordered("session", "scene").rowsBetween(-3, 8)
    return scenes(spark, sf_dir).select("session", "frame", F.min("frame").over(w).alias("first_context"), F.max("frame").over(w).alias("last_context"), F.count("*").over(w).alias("context"), F.round(F.avg("value").over(w), 6).alias("mean_value"))


@query(f"""{SCENES}, n as (select *, row_number() over (partition by session, scene order by frame) as i from sc),
  r as materialized (select * from n), e as (with recursive f as (
    select session, scene, frame, i, value as smooth from r where i = 1 union all
    select r.session, r.scene, r.frame, r.i, r.value * (1 - 0.9) + f.smooth * 0.9 from r join f on r.session = f.session and r.scene = f.scene and r.i = f.i + 1) select * from f)
  select session, frame, round(smooth + 1e-9, 6) as smooth from e""")
def range_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.ema(scenes(spark, sf_dir), ["session", "scene"], ["value"], ["smooth"], 0.9, ["session", "frame"])
    # a little above, as two decimals often make a tie
    return df.select("session", "frame", F.round(F.col("smooth") + 1e-9, 6).alias("smooth"))


@query(f"""{SCENES}, r as materialized (select session, frame, coalesce(delta >= {CUT}, false) as cut, confidence, value from sc), e as (with recursive f as (
    select session, frame, true as refresh, 0::bigint as since from r where frame = 0 union all
    select r.session, r.frame, fresh, case when fresh then 0 else since + 1 end from (
      select r.*, f.since, (r.cut or f.since >= 7 or (f.since >= 2 and (r.confidence < 0.1 or r.value > 90))) as fresh from r join f on r.session = f.session and r.frame = f.frame + 1) r) select * from f)
  select session, frame, refresh, since from e""")
def refresh_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenes(spark, sf_dir).select("session", "frame", F.coalesce(F.col("delta") >= CUT, F.lit(False)).alias("cut"), "confidence", F.col("value").alias("motion"))
    return S.refresh_schedule(rows, 8, 3, 0.1, 90.0)


_FOLLOW = "greatest(0.35, least(1.0, 1 - 0.6 * (0.38 * least(value / 100, 1) + 0.24 * (1 - confidence))))"


@query(f"""{TIMELINE}, r as materialized (select session, frame, {_FOLLOW}::double as target from tl), e as (with recursive f as (
    select session, frame, target as level from r where frame = 0 union all
    select r.session, r.frame, f.level + (r.target - f.level) * case when r.target < f.level then 0.55 else 0.30 end from r join f on r.session = f.session and r.frame = f.frame + 1) select * from f)
  select session, frame, round(level, 6) as level from e""")
def asymmetric_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = 0.38 * F.least(F.col("value") / 100, F.lit(1.0)) + 0.24 * (1 - F.col("confidence"))
    rows = timeline(spark, sf_dir).select("session", "frame", F.greatest(F.lit(0.35), F.least(F.lit(1.0), 1 - 0.6 * risk)).alias("target"))
    return S.asymmetric_follow(rows).select("session", "frame", F.round("level", 6).alias("level"))


@query(f"""{SCENES}, r as materialized (select *, row_number() over (partition by session, scene order by frame) as i, least(greatest(0.85 * confidence, 0), 0.75)::double as b from sc), e as (with recursive f as (
    select session, scene, frame, i, value as out from r where i = 1 union all
    select r.session, r.scene, r.frame, r.i, r.value * (1 - r.b) + f.out * r.b from r join f on r.session = f.session and r.scene = f.scene and r.i = f.i + 1) select * from f)
  select session, frame, round(out, 6) as blended from e""")
def temporal_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blended(scenes(spark, sf_dir)).select("session", "frame", F.round("blended", 6).alias("blended"))


@query(f"""{TIMELINE}, p as (select *, lag(value) over (partition by session order by frame) as was from tl), q as (
  select session, count(*) as n, quantile_cont(value, 0.1) as c1, quantile_cont(value, 0.5) as c5, quantile_cont(value, 0.9) as c9, quantile_cont(was, 0.1) as h1, quantile_cont(was, 0.5) as h5, quantile_cont(was, 0.9) as h9
  from p where confidence > 0.62 and was is not null group by session)
  select session, n, round(case when n < 8 or c9 - c1 <= 1e-5 then 1.0 else least(greatest((h9 - h1) / (c9 - c1), 0.72), 1.38) end, 6) as scale,
    round(case when n < 8 or c9 - c1 <= 1e-5 then 0.0 else least(greatest(h5 - c5 * least(greatest((h9 - h1) / (c9 - c1), 0.72), 1.38), -0.2), 0.2) end, 6) as shift from q""")
def history_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and offset that align values with those of the frame before, from quantiles of confident pairs."""
    p = timeline(spark, sf_dir).withColumn("was", F.lag("value").over(S.ordered("session"))).where("confidence > 0.62 and was is not null")
    of = lambda column, name: A.ranked(p, ["session"], column).groupBy("session").agg(F.max("_all").alias(f"n_{name}"), *(A.interpolated(column, share).alias(f"{name}{i}") for i, share in enumerate((0.1, 0.5, 0.9))))
    q = of("value", "c").join(of("was", "h"), "session").withColumnRenamed("n_h", "n")
    c, h = (lambda i: F.col(f"c{i}")), (lambda i: F.col(f"h{i}"))
    scale = F.least(F.greatest((h(2) - h(0)) / F.nullif(c(2) - c(0), F.lit(0.0)), F.lit(0.72)), F.lit(1.38))
    plain = (F.col("n") < 8) | (c(2) - c(0) <= 1e-5)
    shift = F.least(F.greatest(h(1) - c(1) * scale, F.lit(-0.2)), F.lit(0.2))
    return q.select("session", "n", F.round(F.when(plain, 1.0).otherwise(scale), 6).alias("scale"), F.round(F.when(plain, 0.0).otherwise(shift), 6).alias("shift"))


@query(f"""{TIMELINE}, c as (select *, unnest([frame // 12 - 1, frame // 12]) as chunk from tl), m as (
  select *, frame - chunk * 12 as pos from c where chunk >= 0 and frame - chunk * 12 < 16), w as (
  select *, case when pos < 4 and chunk > 0 then 0.25 + 0.5 * pos / 3 when pos >= 12 then 1 - (0.25 + 0.5 * (pos - 12) / 3) else 1.0 end as weight from m)
  select session, frame, count(*) as chunks, round(sum(value * (1 + 0.01 * chunk) * weight) / sum(weight), 6) as value from w group by session, frame""")
def chunk_crossfade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 16 frames that overlap by 4; in an overlap the later one fades in from .25 to .75."""
    rows = timeline(spark, sf_dir).withColumn("chunk", F.explode(F.array(F.floor(F.col("frame") / 12) - 1, F.floor(F.col("frame") / 12))))
    rows = rows.withColumn("at", F.col("frame") - F.col("chunk") * 12).where("chunk >= 0 and at < 16")
    weight = F.when((F.col("at") < 4) & (F.col("chunk") > 0), 0.25 + 0.5 * F.col("at") / 3).when(F.col("at") >= 12, 1 - (0.25 + 0.5 * (F.col("at") - 12) / 3)).otherwise(1.0)
    rows = rows.withColumn("weight", weight).withColumn("made", F.col("value") * (1 + 0.01 * F.col("chunk")))
    return rows.groupBy("session", "frame").agg(F.count("*").alias("chunks"), F.round(F.sum(F.col("made") * F.col("weight")) / F.sum("weight"), 6).alias("value"))


@query(f"{TIMELINE} select session, frame, round(frame / 25.0 + coalesce(sum(case when k > 80 then (k - 80) / 1000.0 else 0 end) over (partition by session order by frame rows unbounded preceding), 0), 6) as due from tl")
def pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a frame is due: frame / fps, shifted by all waits so far over 80 (milliseconds over that)."""
    wait = F.when(F.col("k") > 80, (F.col("k") - 80) / 1000.0).otherwise(0.0)
    return timeline(spark, sf_dir).select("session", "frame", F.round(F.col("frame") / 25.0 + F.sum(wait).over(S.so_far("session")), 6).alias("due"))


@query(f"""{SCENES}, p as (select *, lag(value) over (partition by session, scene order by frame) as was, frame % 8 = 0 as forced from sc)
  select session, frame, forced, (was is not null and confidence >= 0.35 and abs(value - was) <= 24 and not forced) as reused, case when was is not null and confidence >= 0.35 and abs(value - was) <= 24 then round(value * 0.4 + was * 0.6, 6) else value end as seed from p""")
def temporal_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reuse the frame before where it is known, trusted and alike; a forced refresh keeps the blend as a seed only."""
    p = scenes(spark, sf_dir).withColumn("was", F.lag("value").over(S.ordered("session", "scene")))
    alike = F.col("was").isNotNull() & (F.col("confidence") >= 0.35) & (F.abs(F.col("value") - F.col("was")) <= 24)
    forced = F.col("frame") % 8 == 0
    return p.select("session", "frame", forced.alias("forced"), F.coalesce(alike & ~forced, F.lit(False)).alias("reused"), F.when(alike, F.round(F.col("value") * 0.4 + F.col("was") * 0.6, 6)).otherwise(F.col("value")).alias("seed"))


@query(f"""{TIMELINE}, n as (select session, count(*) as total from tl group by session), c as (
  select session, total, unnest(list_concat([0], case when total > 4 then range(4, total, 24) else [] end)) as first from n)
  select session, row_number() over w - 1 as chunk, first, coalesce(lead(first) over w, total) - first as frames from c window w as (partition by session order by first)""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = timeline(spark, sf_dir).groupBy("session").agg(F.count("*").alias("total"))
    rows = totals.select("session", F.posexplode(S.chunk_plan(F.col("total"), 24, 4)).alias("chunk", "c"))
    return rows.select("session", F.col("chunk").cast("long").alias("chunk"), F.col("c.first").alias("first"), (F.col("c.end") - F.col("c.first")).alias("frames"))


@query(f"{TIMELINE}, o as (select session, event_id, lag(event_id) over (partition by session order by frame) as before from tl) select session, count(*) as rows, sum(case when event_id <> before + 1 then 1 else 0 end)::bigint as gaps, max(event_id - before) as largest from o group by session")
def ordering_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an index is not its predecessor's plus one."""
    o = timeline(spark, sf_dir).withColumn("before", F.lag("event_id").over(S.ordered("session")))
    return o.groupBy("session").agg(F.count("*").alias("rows"), F.count_if(F.col("event_id") != F.col("before") + 1).alias("gaps"), F.max(F.col("event_id") - F.col("before")).alias("largest"))
