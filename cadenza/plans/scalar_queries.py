"""Queries of scalar functions: text, numbers, maps, JSON, bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import scalars as X

from .registry import CELLS, TIMELINE, cells, query, table, timeline


@query("""with r as (select o_orderkey as id, case o_orderkey % 5 when 0 then o_custkey || '/1001' when 1 then o_custkey || '/0' when 2 then '29.97' when 3 then 'n/a' else '' end as rate, case when o_orderkey % 11 = 0 then null else o_totalprice / 50 - 100 end as s from orders)
  select id, round(case when try_cast(regexp_extract(rate, '^([0-9.]+)/([0-9.]+)$', 2) as double) > 0 then regexp_extract(rate, '^([0-9.]+)/([0-9.]+)$', 1)::double / regexp_extract(rate, '^([0-9.]+)/([0-9.]+)$', 2)::double else try_cast(rate as double) end, 6) as rate,
    case when s is null or s < 0 then '—' when ceil(s) >= 3600 then printf('%02d:%02d:%02d', ceil(s)::bigint // 3600, ceil(s)::bigint // 60 % 60, ceil(s)::bigint % 60) else printf('%02d:%02d', ceil(s)::bigint // 60 % 60, ceil(s)::bigint % 60) end as clock from r""")
def rates_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    rate = F.when(k == 0, F.concat("o_custkey", F.lit("/1001"))).when(k == 1, F.concat("o_custkey", F.lit("/0"))).when(k == 2, "29.97").when(k == 3, "n/a").otherwise("")
    seconds = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 50 - 100)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(X.parse_rate(rate), 6).alias("rate"), X.format_time(seconds).alias("clock"))


@query(f"""{TIMELINE} select session, frame, round(value, 2) as media_seconds, k as frames, round(value, 2) > 50 as late, kind as tag from tl""")
def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are made from events and parsed again: `key=value` pairs, and a tag before JSON."""
    line = F.format_string("media_seconds=%.2f real_frames=%d", "value", "k")
    tagged = F.concat(F.lit("﻿"), F.upper("kind"), F.lit(" "), F.to_json(F.struct(F.col("value").alias("v"))))
    m = X.key_values(line)
    tag, parsed = X.tagged_json(tagged, "v double")
    t = timeline(spark, sf_dir)
    return t.select("session", "frame", m["media_seconds"].cast("double").alias("media_seconds"), m["real_frames"].cast("long").alias("frames"), (F.round(parsed["v"], 2) > 50).alias("late"), F.lower(tag).alias("tag"))


@query("select o_orderkey as id, case when o_orderkey % 3 <> 0 then o_orderstatus end as note, case when o_orderkey % 6 = 1 then o_orderpriority end as extra from orders")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated records of which the last two fields are optional."""
    line = F.concat_ws("\t", F.lit("CHUNK"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 6 == 1, F.col("o_orderpriority")))
    r = X.record(line, ["tag", "id", "note", "extra"])
    return table(spark, sf_dir, "orders").select(r["id"].cast("long").alias("id"), r["note"].alias("note"), r["extra"].alias("extra"))


@query("""with h as (select page_id, url, regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '^(.*)$', 1) as host from pages)
  select page_id, case when page_id % 3 = 0 then '' else 'accept: ' || page_id || chr(13) || chr(10) end || 'host: ' || host || chr(13) || chr(10) as block, case when page_id % 2 = 0 then 'id=' || page_id end as cookie, host = 'example.net' or host like '%.example.net' as inside, case when page_id % 4 = 0 then 'a_' || page_id end as tag from h""")
def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header blocks, cookie pairs, domain suffixes, memory tags."""
    host, k = F.parse_url("url", F.lit("HOST")), F.col("page_id")
    headers = F.create_map(F.lit("host"), host, F.lit("accept"), F.when(k % 3 == 0, " ").otherwise(k.cast("string")), F.lit("none"), F.lit(None).cast("string"))
    cookie = F.when(k % 2 == 0, F.concat(F.lit("id="), k, F.lit("; Path=/"))).otherwise("broken; x=1")
    tag = F.concat(F.when(k % 4 == 0, "shm://a_").otherwise("shm://a b"), k)
    return table(spark, sf_dir, "pages").select("page_id", X.header_block(headers).alias("block"), X.cookie_pair(cookie).alias("cookie"), X.in_domain(host, "example.net").alias("inside"), X.memory_tag(tag).alias("tag"))


@query(f"""{CELLS} select frame, y, x, round_even(least(1.0, greatest(0.0, v * 2 + 0.5)) * 255, 0)::int as q, round(least(1.0, greatest(0.0, v * 2 + 0.5)) ** 2 * (3 - 2 * least(1.0, greatest(0.0, v * 2 + 0.5))), 8) as s,
  round(sign(v) * pow(greatest(abs(v), 1e-6), 0.78), 8) as cinematic, round(tanh(1.8 * v) / 1.8 + 0.5 * (tanh(2.2 * v) / 2.2 - tanh(1.8 * v) / 1.8), 8) as comfort from cl""")
def shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.clamp(F.col("v") * 2 + 0.5, 0.0, 1.0)
    return cells(spark, sf_dir).select("frame", "y", "x", X.quantised(F.col("v") * 2 + 0.5).alias("q"), F.round(X.smoothstep(a), 8).alias("s"), F.round(X.shaped(F.col("v")), 8).alias("cinematic"), F.round(X.shaped(F.col("v"), 0.5), 8).alias("comfort"))


@query("select p_partkey as id, round(greatest(0, 40 - abs(p_size - 20)) * greatest(0, 40 - abs(p_size - p_partkey % 30))::double / (3200 - greatest(0, 40 - abs(p_size - 20)) * greatest(0, 40 - abs(p_size - p_partkey % 30))), 8) as iou, round((1.02 * p_size + 0.01 * p_partkey + 3) / (0.0001 * p_size + 0.00002 * p_partkey + 1), 6) as u, round((-0.02 * p_size + 0.98 * p_partkey - 5) / (0.0001 * p_size + 0.00002 * p_partkey + 1), 6) as v from part")
def boxes_and_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    u, v = X.projected(size, k, [1.02, 0.01, 3, -0.02, 0.98, -5, 0.0001, 0.00002, 1])
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(X.square_iou(size, size, F.lit(20), k % 30, F.lit(40)), 8).alias("iou"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("select doc_id, sha256(text) as digest, sha256(text) like '0%' as prefix from documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2("text", 256).startswith("0").alias("prefix"))


@query("""select o_orderkey as id, json_object('id', o_orderkey, 'note', case when o_orderkey % 2 = 0 then o_orderstatus end)::varchar as line, case when o_orderkey % 2 = 0 then '[a]' || chr(10) || 'x=9' || chr(10) || 'y=2' else '[a]' || chr(10) || 'x=9' end as ini, (1::bigint << (o_orderkey % 40)::int) | 5 as mask, bit_count(((1::bigint << (o_orderkey % 40)::int) | 5)) as bits from orders""")
def json_ini_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that keeps nulls, a line set or inserted in an INI text, bit masks."""
    k = F.col("o_orderkey")
    made = F.to_json(F.struct(k.alias("id"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("note")), {"ignoreNullFields": "false"})
    ini = X.ini_set(F.when(k % 2 == 0, "[a]\nx=1\ny=2").otherwise("[a]"), "x", "9", "a")
    mask = F.expr("shiftleft(1L, cast(o_orderkey % 40 as int))").bitwiseOR(F.lit(5).cast("long"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), made.alias("line"), ini.alias("ini"), mask.alias("mask"), F.bit_count(mask).alias("bits"))


@query("select p_partkey as id, array_to_string(list_sort(map_keys(m)), ',') as names from (select p_partkey, case when p_size > 25 then map {'encoder': 1, 'enc': 1, 'backbone': 1, 'head': 2} else map {'head': 2} end as m from part)")
def shared_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of one parameter are added to a map wherever one of them is there."""
    aliases = ["encoder", "enc", "backbone"]
    m = F.when(F.col("p_size") > 25, F.create_map(F.lit("enc"), F.lit(1), F.lit("head"), F.lit(2))).otherwise(F.create_map(F.lit("head"), F.lit(2)))
    value = F.coalesce(*(F.element_at(m, a) for a in aliases))
    wanted = F.map_from_arrays(F.array(*map(F.lit, aliases)), F.array_repeat(value, 3))
    missing = F.map_filter(wanted, lambda k, v: v.isNotNull() & ~F.map_contains_key(m, k))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.map_keys(F.map_concat(m, missing))), ",").alias("names"))


@query(f"{CELLS} select frame, y, x, round(1 / (greatest(v, 0) + 0.2), 8) as disparity, round(1 / (greatest(v, 0) + 0.05) * (1 - (least(greatest(abs(v) * 3, 0.3), 1) - 0.3) / 0.7 * 0.8), 8) as with_sky, ((47 * 200 + 157 * (x * 30) + 16 * (y * 30) + 128) >> 8) + 16 as luma, round(least(1, greatest(0, v + 0.5)) * 255 * 255 / 219 - 16 * 255.0 / 219, 6) as expanded from cl")
def pixel_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth to disparity, with and without sky; limited-range luma by integers; limited to full range."""
    v = F.col("v")
    sky = 1 - (X.clamp(F.abs(v) * 3, 0.3, 1.0) - 0.3) / 0.7 * 0.8
    luma = F.shiftright((47 * 200 + 157 * (F.col("x") * 30) + 16 * (F.col("y") * 30) + 128).cast("int"), 8) + 16
    return cells(spark, sf_dir).select("frame", "y", "x", F.round(1 / (F.greatest(v, F.lit(0.0)) + 0.2), 8).alias("disparity"), F.round(1 / (F.greatest(v, F.lit(0.0)) + 0.05) * sky, 8).alias("with_sky"), luma.alias("luma"), F.round(X.clamp(v + 0.5, 0.0, 1.0) * 255 * 255 / 219 - 16 * 255.0 / 219, 6).alias("expanded"))
