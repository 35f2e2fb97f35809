"""Mixing sources to target weights by weighted fair queueing.

Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all
sizes; a source's target stops at MAX_EPOCHS times its own size, and what it leaves is shared by weight among the
others. Each source's documents stand in a shuffled order (by a hash of the id). Its tokens so far, divided by its
target, are a document's virtual finish time; a second and third epoch queue behind the first. The mix is the
queue of all copies in order of finish time, cut off where it would pass the total budget.

Everything is a DataFrame operation. Rows at one place of the order (same id, source and size) stand or fall together,
so they are added up first, and a key that a third of the rows share is one row. A source may hold a third of the
rows, so no window spans its rows: running totals are made inside hash ranges of the shuffled order, of some hundred
rows; ranges add up inside blocks of BLOCK ranges; only a source's blocks, one for about a million rows, meet in a task. The copies are then sorted globally by finish time into ranges of at most
about SORT_ROWS rows; the ranges' sums tell the one that holds the cut, and only there a running total is made. What
comes out is a row per source, with its last copy in the mix; documents need no shuffle to be compared with it.

Defined cases: a null text has size 0, and documents without words are not in the mix; null ids share one place in the order; repeated rows (same id, source and
size) stay together, in or out; an empty table gives an empty result; `mixed` keeps extra columns, `shares`
ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, packed, stage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_IN_RANGE = 256
BLOCK = 4096
SORT_ROWS = 1 << 20
#: A table of sources with at most so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 20_000
SEED = "mix"


def _sized(docs: DataFrame, prefix: str = "") -> DataFrame:
    """`docs` with _size and _place, the place in the shuffled order; prefix: of a struct that holds text and doc_id."""
    doc_id = F.col(f"{prefix}doc_id")
    size = F.coalesce(F.regexp_count(f"{prefix}text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    id_ = F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))
    return docs.withColumn("_size", size).withColumn("_place", F.struct(key.alias("key"), id_.alias("id"), F.col("_size").alias("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, _size); one row per source.

    A source's level is MAX_EPOCHS * size / weight. With sources in order of level, the first k are capped, for the
    smallest k at which the water level of the rest, (budget - capped) / (their weight), is at most the next level.
    """
    all_ = Window.partitionBy(F.lit(0))
    per = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    number = F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((number - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("cap", MAX_EPOCHS * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    before = all_.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    water = (F.sum("source_size").over(all_) - F.col("capped")) / (F.sum("weight").over(all_) - F.col("gone"))
    first = F.struct(F.row_number().over(all_.orderBy("level", F.col("source").asc_nulls_last())).alias("at"), water.alias("water"))
    per = per.withColumn("first", F.when(water <= F.col("level"), first)).withColumn("water", F.min("first").over(all_)["water"])
    target = F.when(F.col("level") <= F.coalesce("water", "level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water"))
    return per.select("source", "source_size", target.alias("target"))


def _beside(rows: DataFrame, sources: DataFrame, columns: list[str], source: str = "source") -> DataFrame:
    """`rows` with columns of their source's row. `sources` is checkpointed, so its count is cheap."""
    small = sources.select(F.col("source").alias("_source"), *columns)
    small = F.broadcast(small) if sources.count() <= BROADCAST_ROWS else small
    return rows.join(small, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def _running(places: DataFrame) -> DataFrame:
    """Rows (source, _size, _place), one per place of a source, with _cum, the source's running total of _size in order of _place."""
    n, ranges = places.count(), 1
    while ranges * ROWS_IN_RANGE < n:
        ranges *= 2
    hashed = F.conv(F.substring("_place.key", 1, 10), 16, 10).cast("long")
    at = places.withColumn("_range", F.floor(hashed * ranges / 16**10).cast("long"))
    before = lambda keys, by: F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = at.groupBy("source", "_range").agg(F.sum("_size").alias("_sum")).withColumn("_block", F.floor(F.col("_range") / BLOCK))
    if ranges > BLOCK:
        blocks = sums.groupBy("source", "_block").agg(F.sum("_sum").alias("_sum"))
        blocks = blocks.select(F.col("source").alias("_bs"), F.col("_block").alias("_b"), before(["source"], "_block").alias("_base"))
        sums = sums.withColumn("_start", before(["source", "_block"], "_range"))
        sums = sums.join(blocks, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_b"))).withColumn("_start", F.col("_start") + F.col("_base"))
    else:
        sums = sums.withColumn("_start", before(["source"], "_range"))
    starts = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start")
    inside = F.sum("_size").over(Window.partitionBy("source", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    joined = at.withColumn("_in", inside).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return joined.select("source", "_size", "_place", "source_size", "target", (F.col("_start") + F.col("_in")).alias("_cum"))


def _within(copies: DataFrame, budget: int) -> DataFrame:
    """source, epoch, _place of the copies before the budget is passed, in order of (vft, _place, epoch)."""
    spark, order = copies.sparkSession, ["vft", "_place", "epoch"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), copies.count() // SORT_ROWS + 1)
    queue = stage(copies.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    used, cut = 0, None
    for r in queue.groupBy("_range").agg(F.sum("_size").alias("n")).orderBy("_range").collect():  # a row per range
        if used + r["n"] > budget:
            cut = r["_range"]
            break
        used += r["n"]
    columns = ["source", "epoch", "_place"]
    if cut is None:
        return queue.select(*columns)
    # The sources' rows at one finish time and place are one step of the queue.
    total = F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    inside = queue.where(F.col("_range") == cut).withColumn("_total", total).where(F.col("_total") <= budget - used)
    return queue.where(F.col("_range") < cut).select(*columns).unionByName(inside.select(*columns))


def last_copies(rows: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target and `last`, the (epoch, place) of its last copy in the mix (null: none).

    rows: source, _size, _place; checkpointed.
    """
    sources = checkpoint(targets(rows))
    places = checkpoint(rows.where("_size > 0").groupBy("source", "_place").agg(F.sum("_size").alias("_size")))
    queue = checkpoint(_running(_beside(places, sources, ["source_size", "target"])))
    finish = F.array(*(F.struct(((e * F.col("source_size") + F.col("_cum")) / F.col("target")).alias("vft"), F.lit(e).alias("epoch")) for e in range(MAX_EPOCHS)))
    copies = queue.select("source", "_size", "_place", F.explode(finish).alias("c")).select("source", "_size", "_place", "c.vft", "c.epoch")
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    ends = _within(copies, budget).groupBy("source").agg(F.max(F.struct("epoch", F.col("_place").alias("place"))).alias("last"))
    joined = sources.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return checkpoint(joined.select("source", "source_size", "target", "last"))


def _copies() -> Column:
    """How many copies of a row are in the mix."""
    return F.when(F.col("last").isNull() | (F.col("_size") == 0), 0).otherwise(F.col("last.epoch") + F.when(F.col("_place") <= F.col("last.place"), 1).otherwise(0))


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, copies counted) of every document."""
    rows = checkpoint(_sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", "_place"))
    beside = _beside(rows, last_copies(rows), ["source_size", "target", "last"])
    return beside.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies()).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, as often as it takes them, with their columns as they were."""
    rows = checkpoint(_sized(docs.select("doc_id", "source", "text")).select("source", "_size", "_place"))
    beside = _beside(_sized(packed(docs), "_doc."), last_copies(rows), ["last"], "_doc.source")
    return beside.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _copies()))).select("_doc.*")
