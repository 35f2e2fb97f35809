"""Queries that select: argmax with ties, covers, tilings, coalescing, sets, filters and validation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import cover as C
from cadenza.operators import select as X
from cadenza.operators import settings as V

from .aggregate_queries import components
from .join_queries import AROUND, _around
from .registry import CELLS, TIMELINE, cells, query, table, timeline

_SCORE = "donor_confidence * exp(-2.5 * abs(donor_value - value) / 100) * pow(0.985, abs(off))"


@query(f"{AROUND}, s as (select *, {_SCORE} as score from ar), r as (select *, row_number() over (partition by session, frame order by score desc, ord) as r from s where score > 0) select session, frame, off as \"offset\", round(score, 8) as score from r where r = 1")
def best_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, likeness and nearness make a donor's score; a tie goes to the earlier candidate."""
    score = F.col("donor_confidence") * F.exp(-2.5 * F.abs(F.col("donor_value") - F.col("value")) / 100) * F.pow(F.lit(0.985), F.abs("offset"))
    return X.best(_around(spark, sf_dir), ["session", "frame"], score, "order", ["offset"]).withColumn("score", F.round("score", 8))


@query("select p_brand, min(p_partkey) filter (p_retailprice = m) as best, m as error from (select *, min(p_retailprice) over (partition by p_brand) as m from part) group by p_brand, m")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least error, the first of equals."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"), F.min("p_retailprice").alias("error"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query(f"""{CELLS}, m as (select frame, bit_or(pow(2, y * 8 + x)::ubigint) as bits, count(*) as total from cl where v > 0.1 group by frame),
  sq as materialized (select y * 6 + x as i, x::int as x0, y::int as y0, pow(2, y * 8 + x)::ubigint * (7 + 7 * 256 + 7 * 65536)::ubigint as square from range(6) a(y), range(6) b(x)), g as (with recursive r as (
    select frame, bits, total, -1 as rank, 0 as x0, 0 as y0, 0 as gain from m union all
    select frame, bits, total, rank, x0, y0, gain from (
      select r.frame, r.bits - (r.bits & square) as bits, total, rank + 1 as rank, sq.x0, sq.y0, bit_count(r.bits & square)::int as gain, row_number() over (partition by r.frame order by bit_count(r.bits & square) desc, i) as place
      from r, sq where rank < 3 and total - bit_count(r.bits) < 0.985 * total) where place = 1 and gain > 0) select * from r)
  select frame, rank, x0, y0, gain from g where rank >= 0""")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda g: [(i, *r) for i, r in enumerate(C.greedy_cover(g > 0.1, 3))]
    return X.per_grid(_grids(spark, sf_dir), make, "frame long, rank int, x0 int, y0 int, gain int", ["frame", "rank", "x0", "y0", "gain"], [pa.int64(), *[pa.int32()] * 4])


@query(f"""{CELLS}, m as materialized (select frame, y, x, y * 8 + x as own from cl where v > 0.1), l as (with recursive r as (
    select frame, y, x, own as least from m union
    select m.frame, m.y, m.x, r.least from r join m on m.frame = r.frame and abs(m.y - r.y) <= 1 and abs(m.x - r.x) <= 1 and r.least < m.own) select frame, y, x, min(least) as least from r group by all),
  b as materialized (select frame, list([x0, y0, x1, y1] order by least) as boxes from (select frame, least, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from l group by frame, least) group by frame), g as (with recursive r as (
    select frame, boxes from b union all
    select frame, [case when k = ij[1] then [least(boxes[k][1], boxes[ij[2]][1]), least(boxes[k][2], boxes[ij[2]][2]), greatest(boxes[k][3], boxes[ij[2]][3]), greatest(boxes[k][4], boxes[ij[2]][4])] else boxes[k] end for k in range(1, len(boxes) + 1) if k <> ij[2]] from (
      select frame, boxes, [i, j] as ij, row_number() over (partition by frame order by
        ((boxes[i][1] + boxes[i][3]) / 2 / 8 - (boxes[j][1] + boxes[j][3]) / 2 / 8) ** 2 + ((boxes[i][2] + boxes[i][4]) / 2 / 8 - (boxes[j][2] + boxes[j][4]) / 2 / 8) ** 2, i, j) as place
      from r, range(1, 33) s(i), range(1, 33) t(j) where i < j and j <= len(boxes) and len(boxes) > 2) where place = 1) select * from r where len(boxes) <= 2)
  select frame, q[1]::int as x0, q[2]::int as y0, q[3]::int as x1, q[4]::int as y1 from (select frame, unnest(boxes) as q from g)""")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(grid):
        found = [(int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())) for ys, xs in components(grid > 0.1)]
        return X.merged_boxes(found, 2, *grid.shape[::-1])

    return X.per_grid(_grids(spark, sf_dir), make, "frame long, x0 int, y0 int, x1 int, y1 int", ["frame", "x0", "y0", "x1", "y1"], [pa.int64(), *[pa.int32()] * 4])


@query()
def roi_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of their own sizes over a closed mask's components of three cells and more."""
    found = C.masks(_grids(spark, sf_dir), lambda values: X.closed(X.grid_of(values) > 0.15, 1), components, 3)
    return C.roi_cover(found, side=4, overlap=1, context=1.25, least=3, most=4, snap=1, smallest=2)


@query(f"""{CELLS}, s as (select * from cl where v > 0.15), b as (
    select distinct frame, (y + dy) // 2 as by_, (x + dx) // 2 as bx from s, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where y + dy between 0 and 7 and x + dx between 0 and 7), i as (
    select *, bx - row_number() over (partition by frame, by_ order by bx) as isle from b), p as (
    select *, (row_number() over (partition by frame, by_, isle order by bx) - 1) // 2 as pair from i), c as (
    select frame, by_, min(bx) * 2 as x0, max(bx) * 2 + 2 as x1 from p group by frame, by_, isle, pair), d as (
    select *, by_ - row_number() over (partition by frame, x0, x1 order by by_) as band from c), e as (
    select *, (row_number() over (partition by frame, x0, x1, band order by by_) - 1) // 3 as third from d), r as (
    select frame, x0, min(by_) * 2 as y0, x1, max(by_) * 2 + 2 as y1 from e group by frame, x0, x1, band, third)
  select frame, x0::int as x0, y0::int as y0, x1::int as x1, y1::int as y1, greatest(0, (x0 - 1) // 2 * 2 * (x0 > 0)::int)::int as outer_x0, greatest(0, (y0 - 1) // 2 * 2 * (y0 > 0)::int)::int as outer_y0, least(8, (x1 + 2) // 2 * 2)::int as outer_x1, least(8, (y1 + 2) // 2 * 2)::int as outer_y1 from r""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint tiles of 2 x 2 blocks, up to two wide and three high, that own every cell within one of a cell over .15; the halo of one snaps to twos."""
    names = ["frame", *(a + b for a in ("", "outer_") for b in ("x0", "y0", "x1", "y1"))]
    return X.per_grid(_grids(spark, sf_dir), lambda g: X.tiles(g > 0.15, 2, 1, 1, 2), "frame long, " + ", ".join(f"{n} int" for n in names[1:]), names, [pa.int64(), *[pa.int32()] * 8])


@query(f"{TIMELINE} select session, k, min(frame) as first_at from tl group by session, k")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.distinct_in_order(timeline(spark, sf_dir), ["session"], "k", "frame")


@query("select s_suppkey, s_acctbal from supplier where s_nationkey % 2 = 0 and s_acctbal > 0 order by s_acctbal desc, s_suppkey limit 1")
def largest_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of what is fit and ready."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0 and s_acctbal > 0")
    return s.orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(1).select("s_suppkey", "s_acctbal")


@query("""with w as (select * from (values (1, 'PROMO'), (2, 'ECONOMY'), (3, 'SMALL')) as w(rank, type)), r as (select p_brand, p_type from part where p_size > 45 group by all)
  select b.p_brand, coalesce(arg_min(w.type, w.rank), 'none') as used, 'PROMO' as preferred, coalesce(min(w.rank) > 1, true) as fallback from (select distinct p_brand from part) b left join r on r.p_brand = b.p_brand left join w on w.type = r.p_type group by b.p_brand""")
def first_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an ordered preference that is there, else none, and what was preferred."""
    part = table(spark, sf_dir, "part")
    rank = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "ECONOMY", 2).when(F.col("p_type") == "SMALL", 3)
    ready = F.when(F.col("p_size") > 45, rank)
    b = part.groupBy("p_brand").agg(F.min(ready).alias("rank"))
    used = F.element_at(F.array(*map(F.lit, ("PROMO", "ECONOMY", "SMALL"))), F.col("rank"))
    return b.select("p_brand", F.coalesce(F.when(F.col("rank").isNotNull(), used), F.lit("none")).alias("used"), F.lit("PROMO").alias("preferred"), F.coalesce(F.col("rank") > 1, F.lit(True)).alias("fallback"))


@query(f"{TIMELINE}, r as (select *, row_number() over (partition by session order by frame desc) as r from tl where kind = 'error') select session, frame, value from r where r <= 4")
def last_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_rows(timeline(spark, sf_dir).where("kind = 'error'"), ["session"], "frame", 4).select("session", "frame", "value")


@query(f"{TIMELINE}, n as (select *, kind in ('view', 'click') as m, lead(kind in ('view', 'click')) over (partition by session order by frame) as nx from tl) select session, frame, kind from n where not (m and coalesce(nx, false))")
def event_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.coalesced(timeline(spark, sf_dir), ["session"], "frame", F.col("kind").isin("view", "click")).select("session", "frame", "kind")


@query("select p_partkey from part where p_size > 40 union select l_partkey from lineitem where l_quantity > 49")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey").union(table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")).distinct()


@query("select p_partkey from part where p_size > 20 intersect select l_partkey from lineitem where l_quantity > 45")
def mask_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 20").select("p_partkey").intersect(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("select p_partkey from part where p_size > 20 except select l_partkey from lineitem where l_quantity > 45")
def mask_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 20").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("select o_orderkey as key, case when o_orderkey % 9 = 0 then 'new' else o_orderstatus end as status from orders")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return X.upserted(o, o.where("key % 9 = 0").withColumn("status", F.lit("new")), "key")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' union all select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'")
def chained_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").unionByName(o.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"))


@query("""with p as (select p_partkey, printf('%.1f', p_size / 5.0) as divergence, lower(p_type) as method, (p_partkey % 12)::varchar as steps, case when p_partkey % 13 = 0 then 'yes' else 'true' end as enabled, p_partkey % 17 = 0 as unknown from part)
  select p_partkey, case when unknown then 'colour: unknown' else 'ok' end as extra, case when divergence::double > 8 then 'range' else 'ok' end as divergence, case when method in ('economy', 'small', 'promo') then 'ok' else 'choice' end as method, case when steps::int > 10 then 'range' else 'ok' end as steps, case when enabled in ('true', 'false') then 'ok' else 'type' end as enabled from p""")
def settings_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as settings maps against a table of rules: unknown keys, types, choices, ranges, defaults."""
    p = table(spark, sf_dir, "part")
    made = F.create_map(
        F.lit("divergence"), F.format_string("%.1f", F.col("p_size") / 5.0), F.lit("method"), F.lower("p_type"), F.lit("steps"), (F.col("p_partkey") % 12).cast("string"),
        F.lit("enabled"), F.when(F.col("p_partkey") % 13 == 0, "yes").otherwise("true"), F.when(F.col("p_partkey") % 17 == 0, "colour").otherwise("ipd"), F.lit("0"),
    )
    rules = [V.Rule("divergence", "number", 2.0, 0, 8), V.Rule("method", "choice", "small", options=("economy", "small", "promo")), V.Rule("steps", "integer", 1, 0, 10), V.Rule("enabled", "flag", "true"), V.Rule("ipd", "number", 0, -10, 10)]
    checked = p.select("p_partkey", V.problems(made, rules).alias("e"))
    status = lambda k: F.coalesce(F.element_at("e", k), F.lit("ok")).alias(k)
    extra = F.when(F.element_at("e", "colour").isNotNull(), F.concat(F.lit("colour: "), F.element_at("e", "colour"))).otherwise("ok")
    return checked.select("p_partkey", extra.alias("extra"), *(status(k) for k in ("divergence", "method", "steps", "enabled")))


@query("select p_partkey, coalesce(case when p_partkey % 17 <> 0 then p_size::double end, 8.0) as value from part")
def settings_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("p_partkey") % 17 != 0, F.create_map(F.lit("value"), F.col("p_size").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.element_at(m, "value"), F.lit(8.0)).alias("value"))


@query(f"{TIMELINE} select session, frame, k, value, confidence >= 0.08 and value between 0 and 80 as valid, round(exp(-abs(value - k) / greatest(0.65 + 0.035 * k, 0.001)) * exp(-value / 28), 8) as reliability from tl")
def flow_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside and trusted; and a reliability that falls with the round-trip error and the photometric error."""
    reliability = F.exp(-F.abs(F.col("value") - F.col("k")) / F.greatest(0.65 + 0.035 * F.col("k"), F.lit(0.001))) * F.exp(-F.col("value") / 28)
    return timeline(spark, sf_dir).select("session", "frame", "k", "value", ((F.col("confidence") >= 0.08) & F.col("value").between(0, 80)).alias("valid"), F.round(reliability, 8).alias("reliability"))


@query(f"{CELLS}, q as (select frame, coalesce(quantile_cont(v, 0.8) filter (v > 0.015), 1.0) as top from cl group by frame) select cl.frame, y, x from cl join q using (frame) where v > 0.015 and v <= top and not (x < 1 or x >= 7)")
def feature_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over .015 and up to the .8 quantile of those, without the outer columns."""
    c = cells(spark, sf_dir)
    q = c.groupBy("frame").agg(F.coalesce(F.percentile(F.when(F.col("v") > 0.015, F.col("v")), 0.8), F.lit(1.0)).alias("top"))
    return c.join(q, "frame").where("v > 0.015 and v <= top and not (x < 1 or x >= 7)").select("frame", "y", "x")


@query(f"{CELLS}, w as (select *, max(v) over (partition by frame, y order by x rows between 1 preceding and 1 following) as near from cl) select frame, y, x, v < -0.1 and near <= 0.15 and not (x between 3 and 4) as hole from w")
def geometry_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole only where nothing landed near it and the reprojection is off."""
    near = F.max("v").over(Window.partitionBy("frame", "y").orderBy("x").rowsBetween(-1, 1))
    return cells(spark, sf_dir).select("frame", "y", "x", ((F.col("v") < -0.1) & (near <= 0.15) & ~F.col("x").between(3, 4)).alias("hole"))


@query("select o_orderkey, sum(case when l_orderkey is null then 0 else 1 end)::bigint as lines, count(l_orderkey) = 4 as exact from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made against expected: four lines an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", n.cast("long").alias("lines"), (n == 4).alias("exact"))


@query("select c_custkey, case when c_mktsegment = 'AUTOMOBILE' and c_nationkey < 5 then 'segment' when c_acctbal < 0 and c_nationkey > 20 then 'balance' end as problem, c_acctbal >= 64 and c_mktsegment in ('BUILDING', 'MACHINERY') and c_name not like '%99' as fit from customer")
def mode_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across columns: the first that is broken, and a conjunction that output must meet."""
    problem = F.when((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_nationkey") < 5), "segment").when((F.col("c_acctbal") < 0) & (F.col("c_nationkey") > 20), "balance")
    fit = (F.col("c_acctbal") >= 64) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_name").endswith("99")
    return table(spark, sf_dir, "customer").select("c_custkey", problem.alias("problem"), fit.alias("fit"))


@query("select page_id, regexp_matches(url, '[\\r\\n]') as broken, list_filter(string_split(url, '/'), lambda p: p <> '' and p <> 'http:' and p <> 'https:')[1] as first_part from pages")
def header_and_track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line ends in values; the first part of a list that passes a filter."""
    parts = F.filter(F.split("url", "/"), lambda p: (p != "") & (p != "http:") & (p != "https:"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("[\\r\\n]").alias("broken"), F.get(parts, F.lit(0)).alias("first_part"))


@query(f"{CELLS}, h as (select *, x - row_number() over (partition by frame, y order by x) as i from cl where v > 0.1), r as (select frame, y, i, count(*) as n from h group by all) select h.frame, h.y, h.x from h join r using (frame, y, i) where n >= 2")
def clean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without those whose run is shorter than two."""
    h = cells(spark, sf_dir).where("v > 0.1").withColumn("i", F.col("x") - F.row_number().over(Window.partitionBy("frame", "y").orderBy("x")))
    return h.withColumn("n", F.count("*").over(Window.partitionBy("frame", "y", "i"))).where("n >= 2").select("frame", "y", "x")


@query("select p_partkey, coalesce(p_size >= 10 and p_retailprice > 950 and sha256(p_name) like '%a%' and o.o_orderstatus <> 'F', false) as ready from part left join orders o on o.o_orderkey = p_partkey * 2")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conjunction over looked-up facts; anything unknown makes it false."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 2).alias("half"), "o_orderstatus")
    good = (F.col("p_size") >= 10) & (F.col("p_retailprice") > 950) & F.contains(F.sha2("p_name", 256), F.lit("a")) & (F.col("o_orderstatus") != "F")
    p = table(spark, sf_dir, "part").withColumn("half", F.col("p_partkey").cast("double"))
    return p.join(o, "half", "left").select("p_partkey", F.coalesce(good, F.lit(False)).alias("ready"))
