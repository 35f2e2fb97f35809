"""Queries register here, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sequences import lagged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function as a query of its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as sessions of frames: a user is a session, its events in time order are frames 0, 1, 2, ...

    value stands for a per-frame measure, k / 99 for a confidence, t for the seconds since the session's first frame.
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("user_id").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "event_id", F.col("event_type").alias("kind"), "value", k.alias("k"), seconds.alias("s"), F.first(seconds).over(w).alias("s0"))
    return rows.select("session", "frame", "event_id", "kind", "value", "k", (F.col("k") / 99).alias("confidence"), F.round(F.col("s") - F.col("s0"), 6).alias("t"))


#: The same, for DuckDB.
TIMELINE = """with tl as (
  select user_id as session, row_number() over w - 1 as frame, event_id, event_type as kind, value,
    json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.k')::double / 99 as confidence,
    round((epoch_us(ts) - first_value(epoch_us(ts)) over w) / 1e6, 6) as t
  from events window w as (partition by user_id order by ts, event_id))
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 8 x 8 grids: one row (frame, scene, y, x, v) per cell."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("frame"), F.col("label").alias("scene"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return rows.select("frame", "scene", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "v")


def whole_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, whole: one row (frame, grids) per frame; a frame that the table has once has one list."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) > 0")
    return e.groupBy(F.col("vec_id").alias("frame")).agg(F.collect_list("embedding").alias("grids")).withColumn("grids", F.col("grids").cast("array<array<double>>"))


def lagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cells` and was, the cell of the frame before of the scene; a scene's first frame is left out. Grids are lagged whole."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("scene"), F.col("embedding").cast("array<double>").alias("e"))
    rows = lagged(e, ["scene"], "frame", "e", "before").where("before is not null")
    rows = rows.select("frame", "scene", F.posexplode(F.arrays_zip("e", "before")).alias("i", "c"))
    return rows.select("frame", "scene", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("c.e").alias("v"), F.col("c.before").alias("was")).where("was is not null")


#: The same, for DuckDB; it goes on after a comma.
CELLS = """with cl as (
  select vec_id as frame, label as scene, ((i - 1) // 8)::int as y, ((i - 1) % 8)::int as x, v::double as v
  from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings))
"""
