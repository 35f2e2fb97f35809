"""Visibility splatting and overlap-add: what many sources leave on a target.

Depths are put in few layers, so rows add up by target and layer, which combines before the shuffle, however many meet
at a target. A target's handful of layers then tells which is in front, and layers within a tolerance of it count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taps(position: Column, weight_least: float = 1e-4) -> Column:
    """The two targets about a fractional position and their bilinear weights; a weight under the least is left out."""
    low = F.floor(position)
    two = F.array(F.struct(low.cast("long").alias("target"), (1 - (position - low)).alias("weight")), F.struct((low + 1).cast("long").alias("target"), (position - low).alias("weight")))
    return F.filter(two, lambda t: t["weight"] > weight_least)


def splat(rows: DataFrame, tolerance: float, least: float = 0.02) -> DataFrame:
    """Rows (target, layer, weight, colour): the weighted mean of each target's front layer, the far layer's, and validity. Layers are few."""
    layers = rows.groupBy("target", "layer").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("colour")).alias("wc"), F.count("*").alias("n"))
    of = layers.groupBy("target").agg(F.max("layer").alias("front"), F.min("layer").alias("far_layer"), F.collect_list(F.struct("layer", "w", "wc", "n")).alias("_all"))
    near, far = F.filter("_all", lambda a: a["layer"] >= F.col("front") - tolerance), F.filter("_all", lambda a: a["layer"] <= F.col("far_layer") + tolerance)
    total = lambda some, c: F.aggregate(some, F.lit(0.0), lambda s, a: s + a[c])
    out = of.withColumns({"_near": near, "_far": far}).select(
        "target", "front", "far_layer", F.aggregate("_near", F.lit(0).cast("long"), lambda s, a: s + a["n"]).alias("hits"), total("_near", "w").alias("coverage"),
        (total("_near", "wc") / total("_near", "w")).alias("near"), (total("_far", "wc") / total("_far", "w")).alias("far"),
    )
    return out.withColumn("valid", F.col("coverage") >= least)


def overlap_add(rows: DataFrame, keys: list[str], value: str, weight: str, least: float = 1e-4) -> DataFrame:
    """Weighted sum over weight sum, the latter at least `least`."""
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(least))).alias("value"), F.count("*").alias("tiles"))
