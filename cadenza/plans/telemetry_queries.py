"""Queries of telemetry: levels, rates, episodes, flags, alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import sequences as S
from cadenza.operators import telemetry as M

from .registry import TIMELINE, query, table, timeline


@query(f"""{TIMELINE}, l as (select session, frame, kind, sum(case when kind = 'view' then 24 when kind = 'click' then -24 else 0 end) over (partition by session order by frame rows unbounded preceding)::bigint as level from tl)
  select session, frame, level, level >= 48 as full, level < 0 as starved from l""")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent minus acknowledged, against a limit."""
    change = F.when(F.col("kind") == "view", 24).when(F.col("kind") == "click", -24).otherwise(0)
    t = timeline(spark, sf_dir).withColumn("level", F.sum(change).over(S.so_far("session")))
    return t.select("session", "frame", "level", (F.col("level") >= 48).alias("full"), (F.col("level") < 0).alias("starved"))


@query(f"""{TIMELINE}, n as (select session, count(*) as total from tl group by session), c as (select session, total, least(total, ceil((25 * 2.0 + 0.5 * 24) / 24)::bigint * 24) as capacity from n), l as (
    select tl.session, frame, capacity, sum(case when k < 50 then 24 else -24 end) over (partition by tl.session order by frame rows unbounded preceding) as level from tl join c on c.session = tl.session)
  select session, max(capacity) as capacity, min(capacity) + 48 as startup, sum((level + 24 > capacity)::int)::bigint as blocked from l group by session""")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer's capacity in whole chunks, capped at the total; how often the next chunk would not fit."""
    total = F.count("*").over(Window.partitionBy("session"))
    capacity = F.least(total, F.ceil(F.lit((25 * 2.0 + 0.5 * 24) / 24)) * 24)
    level = F.sum(F.when(F.col("k") < 50, 24).otherwise(-24)).over(S.so_far("session"))
    t = timeline(spark, sf_dir).withColumn("capacity", capacity).withColumn("level", level)
    return t.groupBy("session").agg(F.max("capacity").alias("capacity"), (F.min("capacity") + 48).alias("startup"), F.count_if(F.col("level") + 24 > F.col("capacity")).alias("blocked"))


@query(f"""{TIMELINE}, r as materialized (select session, frame, t from tl), e as (with recursive f as (
    select session, frame, t, t as start, 0 as n, false as closed, null::double as fps from r where frame = 0 union all
    select r.session, r.frame, r.t, case when r.t - f.start >= 7200 then r.t else f.start end, case when r.t - f.start >= 7200 then 0 else f.n + 1 end, r.t - f.start >= 7200, case when r.t - f.start >= 7200 then (f.n + 1) / (r.t - f.start) end
    from r join f on r.session = f.session and r.frame = f.frame + 1) select * from f)
  select session, frame, round(fps * 3600, 6) as per_hour from e where closed""")
def data_driven_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that close at the first frame two hours after their start; not aligned to any clock."""
    return M.data_windows(timeline(spark, sf_dir).select("session", "frame", "t"), 7200).select("session", "frame", F.round(F.col("fps") * 3600, 6).alias("per_hour"))


@query(f"""{TIMELINE}, a as (select *, k > 80 as late, coalesce(lag(k > 80) over (partition by session order by frame), false) as was from tl), e as (select *, sum((late and not was)::int) over (partition by session order by frame rows unbounded preceding)::bigint as episode from a)
  select session, episode, min(frame) as first, max(frame) as last, count(*) as length, max(k) as longest_wait from e where late group by session, episode""")
def underruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.episodes(timeline(spark, sf_dir), F.col("k") > 80)


_ON = "coalesce(last_value(case when kind = '{0}' then true when kind = '{1}' then false end ignore nulls) over (partition by session order by frame rows unbounded preceding), false)"
FLAGS = f"{TIMELINE}, fl as (select *, {_ON.format('click', 'view')} as paused, {_ON.format('error', 'purchase')} as buffering, {_ON.format('signup', 'view')} as muted from tl)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return M.flags(timeline(spark, sf_dir), {"paused": kind == "click", "buffering": kind == "error", "muted": kind == "signup"}, {"paused": kind == "view", "buffering": kind == "purchase", "muted": kind == "view"})


@query(f"{FLAGS} select session, frame, paused, buffering, muted from fl")
def player_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("session", "frame", "paused", "buffering", "muted")


@query(f"""{FLAGS}, b as (select *, greatest(0, sum(case when k % 2 = 0 then 2 else -1 end) over (partition by session order by frame rows unbounded preceding))::bigint as remaining from fl)
  select session, frame, remaining, round(remaining / 25.0, 4) as seconds, case when buffering then 'rebuffering' when paused then 'pause' when remaining >= 20 then 'full' else 'filling' end as state from b""")
def buffer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    remaining = F.greatest(F.lit(0), F.sum(F.when(F.col("k") % 2 == 0, 2).otherwise(-1)).over(S.so_far("session")))
    b = _flags(spark, sf_dir).withColumn("remaining", remaining)
    state = F.when(F.col("buffering"), "rebuffering").when(F.col("paused"), "pause").when(F.col("remaining") >= 20, "full").otherwise("filling")
    return b.select("session", "frame", "remaining", F.round(F.col("remaining") / 25.0, 4).alias("seconds"), state.alias("state"))


@query(f"""{TIMELINE}, r as materialized (select session, frame, t, abs(value - 50) > 20 as over_ from tl), e as (with recursive f as (
    select session, frame, t, case when over_ then t end as since, null::double as last, false as alarm from r where frame = 0 union all
    select session, frame, t, since, case when alarm then t else last end, alarm from (
      select r.session, r.frame, r.t, f.last, case when r.over_ then coalesce(f.since, r.t) end as since, coalesce(r.over_ and r.t - coalesce(f.since, r.t) >= 3600 and (f.last is null or r.t - f.last >= 86400), false) as alarm from r join f on r.session = f.session and r.frame = f.frame + 1)) select * from f)
  select session, frame, alarm from e""")
def drift_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the limit for an hour, and at most one alarm a day."""
    rows = timeline(spark, sf_dir).select("session", "frame", "t", (F.col("value") - 50).alias("drift"))
    return S.fold(rows, ["session"], lambda: (None, None), M.alarm_step(20, 3600, 86400), "alarm boolean", ["session", "frame"])


@query(f"""{TIMELINE}, a as materialized (select session, frame, case when k % 3 = 0 then 'take' else 'schedule' end as action, floor(frame / 2 + k % 4)::bigint as i from tl), e as (with recursive r as (
    select session, -1::bigint as frame, null::varchar as action, null::bigint as index, [0::bigint][2:] as pending, null::boolean as hit, 0 as discarded from (select distinct session from a) union all
    select session, frame, action, i, kept, hit, case when action = 'take' then len(pending) - len(kept) - hit::int else 0 end from (
      select a.session, a.frame, a.action, i, r.pending, case when action = 'take' then list_contains(r.pending, i) end as hit,
        case when action = 'schedule' then case when list_contains(r.pending, i) then r.pending else list_append(r.pending, i) end when list_contains(r.pending, i) then [x for x in r.pending if x > i] else [x for x in r.pending if x < i] end as kept
      from a join (select session, frame, pending from r) r on a.session is not distinct from r.session and a.frame = r.frame + 1)) select * from r)
  select session, frame, action, index, hit, discarded::bigint as discarded, len(pending) as pending from e where frame >= 0""")
def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules and takes; a hit keeps what is scheduled later, a miss drops it."""
    rows = timeline(spark, sf_dir).select("session", "frame", F.when(F.col("k") % 3 == 0, "take").otherwise("schedule").alias("action"), F.floor(F.col("frame") / 2 + F.col("k") % 4).alias("index"))
    return S.fold(rows, ["session"], tuple, M.prefetch_step, "hit boolean, discarded long, pending long", ["session", "frame", "action", "index"])


@query(f"""{TIMELINE}, f as (select session, arg_min(t, frame) filter (kind = 'view') as t0, arg_min(value, frame) filter (kind = 'view') as pos, count(*) filter (kind in ('view', 'click')) as real_frames, count(*) as presented from tl group by session)
  select session, case when t0 / 3600 - pos / 100 between 0 and 1.5 then round(t0 / 3600 - pos / 100, 6) end as latency, round(pos + 0.25 + least(0.75, greatest(0, t0 / 3600 - pos / 100)), 6) as restart, presented - real_frames as generated, round(presented::double / real_frames, 6) as multiplier from f""")
def startup_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's first latency, where a restart would resume, and generated against real frames."""
    view = F.when(F.col("kind") == "view", F.col("frame"))
    f = timeline(spark, sf_dir).groupBy("session").agg(F.min_by("t", view).alias("t0"), F.min_by("value", view).alias("pos"), F.count_if(F.col("kind").isin("view", "click")).alias("real"), F.count("*").alias("presented"))
    late = F.col("t0") / 3600 - F.col("pos") / 100
    return f.select("session", F.when(late.between(0, 1.5), F.round(late, 6)).alias("latency"), F.round(F.col("pos") + 0.25 + F.least(F.lit(0.75), F.greatest(F.lit(0.0), late)), 6).alias("restart"), (F.col("presented") - F.col("real")).alias("generated"), F.round(F.col("presented") / F.col("real"), 6).alias("multiplier"))


@query("select user_id as session, max(epoch(ts) - epoch(before)) > 86400 * 4 as stalled, max(event_id) as last from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events) group by user_id")
def watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without progress for four days at some point."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = e.withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy(F.col("user_id").alias("session")).agg((F.max("gap") > 86400 * 4).alias("stalled"), F.max("event_id").alias("last"))


@query(f"""{TIMELINE}, s as (select session, frame, sum((k < 10)::int) over (partition by session order by frame rows unbounded preceding)::bigint as scene from tl), c as (select session, scene, count(*) as frames from s group by session, scene)
  select session, count(*) as scenes, sum(frames)::bigint as frames, sum(ceil(frames / 6.0))::bigint as batches, max(frames % 6) as flushed from c group by session""")
def scene_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of six that a cut flushes early: no frame is lost."""
    s = S.with_scene(timeline(spark, sf_dir), F.col("k") < 10).groupBy("session", "scene").agg(F.count("*").alias("frames"))
    return s.groupBy("session").agg(F.count("*").alias("scenes"), F.sum("frames").alias("frames"), F.sum(F.ceil(F.col("frames") / 6.0)).cast("long").alias("batches"), F.max(F.col("frames") % 6).alias("flushed"))
