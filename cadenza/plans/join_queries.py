"""Queries that join streams, catalogues and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import joins as J
from cadenza.operators import sequences as S

from .registry import TIMELINE, query, table, timeline
from .sequence_queries import SCENES, scenes

ORDINAL = f"{TIMELINE}, o as (select *, row_number() over (partition by session, kind order by frame) - 1 as i from tl)"


def _ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("session", "kind").orderBy("frame")) - 1
    return timeline(spark, sf_dir).withColumn("i", i.cast("long"))


@query(f"""{ORDINAL} select coalesce(a.session, b.session) as session, coalesce(a.i, b.i) as i, a.value as left_value, b.value as right_value, (a.i is not null and b.i is not null) as matched
  from (select * from o where kind = 'view') a full join (select * from o where kind = 'click') b on a.session = b.session and a.i = b.i""")
def lockstep_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ordinal(spark, sf_dir)
    side = lambda kind, name: o.where(F.col("kind") == kind).select("session", "i", F.col("value").alias(name))
    return J.lockstep(side("view", "left_value"), side("click", "right_value"), ["session", "i"])


@query(f"{TIMELINE} select a.session, a.frame, b.value as packet from tl a join tl b on a.session = b.session and b.frame = a.frame + 5")
def packet_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    return t.select("session", "frame").join(t.select("session", (F.col("frame") - 5).alias("frame"), F.col("value").alias("packet")), ["session", "frame"])


_OFFSETS = "(values (0,-1),(1,1),(2,-2),(3,2),(4,-4),(5,4),(6,-6),(7,6)) as f(ord, off)"
AROUND = f"{SCENES}, ar as (select a.session, a.scene, a.frame, a.value, f.ord, f.off, b.frame as donor_frame, b.value as donor_value, b.confidence as donor_confidence from sc a, {_OFFSETS} join sc b on b.session = a.session and b.scene = a.scene and b.frame = a.frame + f.off)"


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenes(spark, sf_dir).select("session", "scene", "frame", "value", "confidence")
    return J.around(rows, J.candidate_offsets(6), ["session", "scene"], ["value", "confidence"])


@query(f"{AROUND} select session, frame, off as \"offset\", donor_frame, donor_value from ar")
def lookaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir).select("session", "frame", "offset", "donor_frame", "donor_value")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 0)")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required keys with nothing behind them, or something of size 0."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_totalprice > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select s_suppkey, coalesce(n_name, 'unknown') as nation, coalesce(r_name, 'unknown') as region from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up small catalogues; their files are small enough for Spark to broadcast them by itself."""
    n, r = table(spark, sf_dir, "nation").where("n_nationkey < 20"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("""with e as (select o_orderkey as key, o_totalprice::bigint // 100000 as size, sha256(o_orderpriority) as digest from orders where o_orderkey % 7 <> 0),
  a as (select o_orderkey as key, (o_totalprice::bigint + case when o_orderkey % 11 = 0 then 100000 else 0 end) // 100000 as size, sha256(case when o_orderkey % 13 = 0 then o_orderpriority || '!' else o_orderpriority end) as digest from orders where o_orderkey % 5 <> 0)
  select key, case when a.key is null then 'missing' when e.key is null then case when key % 10 = 0 then 'ok' else 'undeclared' end when key % 10 = 0 then 'ok' when e.size <> a.size then 'size' when e.digest <> a.digest then 'digest' else 'ok' end as status
  from e full join a using (key)""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests made from orders: one lacks every seventh, the other every fifth and differs in some; keys by ten are exempt."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.bround("o_totalprice").cast("long").alias("price"), F.col("o_orderpriority").alias("p"))
    size = lambda extra: F.floor((F.col("price") + extra) / 100000).cast("long").alias("size")
    e = o.where("key % 7 <> 0").select("key", size(0), F.sha2("p", 256).alias("digest"))
    a = o.where("key % 5 <> 0").select("key", size(F.when(F.col("key") % 11 == 0, 100000).otherwise(0)), F.sha2(F.when(F.col("key") % 13 == 0, F.concat("p", F.lit("!"))).otherwise(F.col("p")), 256).alias("digest"))
    return J.classified(e, a, "key", ["size", "digest"], F.col("key") % 10 == 0)


@query(f"""{TIMELINE}, p as (select session, t, value from tl where kind = 'view'), s as (select session, t as sample_at, value as pos, frame from tl where kind = 'click'),
  u as (select session, sample_at, max_by(pos, frame) as pos from s group by session, sample_at)
  select p.session, p.t, p.value, u.sample_at, round(u.pos + greatest(0, p.t - u.sample_at) * 0.001, 6) as estimate, round(p.value - (u.pos + greatest(0, p.t - u.sample_at) * 0.001), 6) as drift
  from p asof left join u on p.session = u.session and p.t >= u.sample_at""")
def clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sample of another clock, carried on at a fixed rate, against this one."""
    t = timeline(spark, sf_dir)
    samples = t.where("kind = 'click'").groupBy("session", "t").agg(F.max_by("value", "frame").alias("pos"))
    joined = J.as_of(t.where("kind = 'view'").select("session", "t", "value"), samples, "session", "t", ["pos"])
    estimate = F.col("pos") + F.greatest(F.lit(0.0), F.col("t") - F.col("sample_at")) * 0.001
    return joined.select("session", "t", "value", "sample_at", F.round(estimate, 6).alias("estimate"), F.round(F.col("value") - estimate, 6).alias("drift"))


@query("select p_partkey, arg_min(s_suppkey, (abs(s_acctbal - p_retailprice), s_suppkey)) as best, round(min(abs(s_acctbal - p_retailprice)), 4) as error from part, supplier group by p_partkey")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all sources, the one that differs least, of equals that with the smaller key."""
    sources = table(spark, sf_dir, "supplier").groupBy(F.col("s_acctbal").alias("at")).agg(F.min("s_suppkey").alias("source"))
    near = J.nearest(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("at")), sources, "at", "source")
    return near.select("p_partkey", F.col("source").alias("best"), F.round("distance", 4).alias("error"))


_CODE = "list_sum(list_transform(range(1, 33), lambda i: case when embedding[i] > 0 then (1::bigint << (i - 1)::int) else 0 end))::bigint"


@query(f"""with c as (select vec_id as id, {_CODE} as code from embeddings), m as (
    select a.id, b.id as other, bit_count(xor(a.code, b.code))::int as d, row_number() over (partition by a.id order by bit_count(xor(a.code, b.code)), b.id) as r from c a, c b where a.id % 20 = 0 and b.id <> a.id)
  select id, max(case when r = 1 then other end) as match, max(case when r = 1 then d end) as distance, max(case when r = 2 then d end) as second, max(case when r = 1 then d end) < 0.72 * max(case when r = 2 then d end) as clear from m where r <= 2 group by id""")
def descriptor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit sign codes of a stated query set, each twentieth id, against all other rows; a match is clear if it has under .72 of the second's distance."""
    bits = [F.when(F.col("embedding")[i] > 0, 1 << i).otherwise(0).cast("long") for i in range(32)]
    code = bits[0]
    for b in bits[1:]:
        code = code + b
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code.alias("code"))
    return J.nearest_two(c.where("id % 20 = 0"), c, 0.72)


@query(f"""{ORDINAL}, p as (select a.session, a.i, a.value as va, b.value as vb, a.k as ka, b.k as kb from o a join o b on a.session = b.session and a.i = b.i where a.kind = 'view' and b.kind = 'error')
  select session, count(*) as compared, sum((va <> vb)::int)::bigint as value_differs, sum((ka <> kb)::int)::bigint as k_differs, (list(i order by i) filter (va <> vb))[1:10]::varchar as first_ten from p group by session""")
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams by ordinal, to the shorter one's end: how often two fields differ, and where first."""
    o = _ordinal(spark, sf_dir)
    side = lambda kind, s: o.where(F.col("kind") == kind).select("session", "i", F.col("value").alias(f"v{s}"), F.col("k").alias(f"k{s}"))
    p = side("view", "a").join(side("error", "b"), ["session", "i"]).withColumn("at", F.when(F.col("va") != F.col("vb"), F.col("i")))
    p = p.withColumn("nth", F.count("at").over(S.so_far("session", by="i")))
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= 10, F.col("at"))))
    return p.groupBy("session").agg(F.count("*").alias("compared"), F.sum((F.col("va") != F.col("vb")).cast("int")).alias("value_differs"), F.sum((F.col("ka") != F.col("kb")).cast("int")).alias("k_differs"), F.concat(F.lit("["), F.array_join(first, ", "), F.lit("]")).alias("first_ten"))


@query(f"{SCENES} select session, frame, round(sum(value) over w, 6) as dx, round(min(confidence) over w, 6) as confidence, count(*) over w as hops from sc window w as (partition by session, scene order by frame rows between current row and 3 following)")
def flow_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement over up to four hops: sums of flow, least confidence."""
    w = S.ordered("session", "scene").rowsBetween(0, 3)
    return scenes(spark, sf_dir).select("session", "frame", F.round(F.sum("value").over(w), 6).alias("dx"), F.round(F.min("confidence").over(w), 6).alias("confidence"), F.count("*").over(w).alias("hops"))


@query("with e as (select vec_id, label, embedding, lag(embedding) over (partition by label order by vec_id) as was from embeddings) select vec_id, round(list_sum(list_transform(list_zip(embedding, was), lambda p: abs(p[1]::double - p[2]::double))) / 64, 6) as mae from e where was is not null")
def lagged_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grid with the one before it of its scene: mean absolute difference."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = S.lagged(e, ["label"], "vec_id", "e", "was").where("was is not null")
    total = F.aggregate(F.zip_with("e", "was", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(total / 64, 6).alias("mae"))


@query("with m as (select doc_id, lang from documents where lang in ('en', 'fr') and contains(lower(text), 'there')), t as (select count(*) as total from m) select doc_id, lang, total from m, t order by doc_id limit 20")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 hits in index order, and how many there are (a search page shows no more)."""
    m = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr") & F.contains(F.lower("text"), F.lit("there"))).select("doc_id", "lang")
    return m.orderBy("doc_id").limit(20).join(F.broadcast(m.agg(F.count("*").alias("total"))))


_GOOD = "abs(donor_value - value) < 40 and donor_confidence > 0.5"


@query(f"{AROUND}, g as (select *, row_number() over (partition by session, frame order by ord) as r from ar where {_GOOD}) select session, frame, off as \"offset\", donor_value from g where r = 1")
def donor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors in order; the first that is accepted stays."""
    good = (F.abs(F.col("donor_value") - F.col("value")) < 40) & (F.col("donor_confidence") > 0.5)
    return J.first_match(_around(spark, sf_dir), ["session", "frame"], "order", good).select("session", "frame", "offset", "donor_value")


@query(f"{AROUND}, p as (select distinct session, least(frame, donor_frame) as a, greatest(frame, donor_frame) as b, frame < donor_frame as forward from ar) select session, a, b, count(*) as directions, bool_or(forward) and bool_or(not forward) as reverse_hit from p group by session, a, b")
def pair_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of a frame pair under one key."""
    r = _around(spark, sf_dir)
    pairs = r.select("session", F.least("frame", "donor_frame").alias("a"), F.greatest("frame", "donor_frame").alias("b"), (F.col("frame") < F.col("donor_frame")).alias("forward")).distinct()
    return pairs.groupBy("session", "a", "b").agg(F.count("*").alias("directions"), (F.bool_or("forward") & F.bool_or(~F.col("forward"))).alias("reverse_hit"))


@query(f"""{AROUND}, g as (select *, row_number() over (partition by session, frame order by ord) as r from ar where {_GOOD}), m as (
  select s.session, s.scene, s.confidence < 0.5 as hole, g.frame is not null as filled from sc s left join g on g.session = s.session and g.frame = s.frame and g.r = 1)
  select session, scene, sum(hole::int)::bigint as mask, sum((hole and filled)::int)::bigint as filled, round(sum((hole and filled)::int) / greatest(1, sum(hole::int)), 6) as coverage from m group by session, scene""")
def repair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what is missing the chosen donors fill."""
    good = (F.abs(F.col("donor_value") - F.col("value")) < 40) & (F.col("donor_confidence") > 0.5)
    chosen = J.first_match(_around(spark, sf_dir), ["session", "frame"], "order", good).select("session", "frame", F.lit(True).alias("got"))
    rows = scenes(spark, sf_dir).join(chosen, ["session", "frame"], "left").withColumn("hole", (F.col("confidence") < 0.5).cast("int"))
    mask, filled = F.sum("hole"), F.sum(F.when(F.col("got"), F.col("hole")).otherwise(0))
    return rows.groupBy("session", "scene").agg(mask.alias("mask"), filled.alias("filled"), F.round(filled / F.greatest(F.lit(1), mask), 6).alias("coverage"))
