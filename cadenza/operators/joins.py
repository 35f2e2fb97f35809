"""Joins of ordered streams.

A band of frame offsets is an explode and an equi-join, never a range join; an as-of join is a union and a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .aggregates import ranges_of


def lockstep(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One to one by key; `matched` is false where one side ends first."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    return a.join(b, list(keys), "full_outer").withColumn("matched", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def candidate_offsets(radius: int) -> list[int]:
    """-1, 1, -2, 2, -4, 4, ... up to the radius, which closes the list."""
    powers = [2**i for i in range(radius.bit_length()) if 2**i <= radius]
    return [sign * d for d in dict.fromkeys([*powers, radius]) for sign in (-1, 1)]


def around(frames: DataFrame, offsets: Sequence[int], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each frame beside its candidates at the offsets, of the same keys; columns of candidates are prefixed donor_."""
    steps = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)))
    wanted = frames.withColumn("_step", F.explode(steps)).select(*frames.columns, F.col("_step.order").alias("order"), F.col("_step.offset").alias("offset")).withColumn("donor_frame", F.col("frame") + F.col("offset"))
    donors = frames.select(*keys, F.col("frame").alias("donor_frame"), *(F.col(c).alias(f"donor_{c}") for c in columns))
    return wanted.join(donors, [*keys, "donor_frame"])


def as_of(probe: DataFrame, samples: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Each probe row with the latest sample at or before it: a union, and one window over key in order of time."""
    sample = F.struct(F.col(at).alias("sample_at"), *(F.col(c) for c in columns))
    left = probe.withColumn("_s", F.lit(None).cast(samples.select(sample.alias("s")).schema["s"].dataType)).withColumn("_probe", F.lit(1))
    both = left.unionByName(samples.select(key, at, sample.alias("_s"), F.lit(0).alias("_probe")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_probe = 1").select(*probe.columns, "_s.*")


def classified(expected: DataFrame, actual: DataFrame, key: str, checks: Sequence[str], exempt: Column) -> DataFrame:
    """Full outer comparison of two manifests; the first check that differs names the status."""
    a = expected.select(key, *(F.col(c).alias(f"_e_{c}") for c in checks), F.lit(True).alias("_e"))
    b = actual.select(key, *(F.col(c).alias(f"_a_{c}") for c in checks), F.lit(True).alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), F.when(exempt, "ok").otherwise("undeclared")).when(exempt, "ok")
    for c in checks:
        status = status.when(~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}")), c)
    return a.join(b, key, "full_outer").select(key, status.otherwise("ok").alias("status"))


def first_match(rows: DataFrame, keys: Sequence[str], order: str, accepted: Column) -> DataFrame:
    """Of the accepted rows of a key, the first in order: later ones never overwrite it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.where(accepted).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest(probe: DataFrame, values: DataFrame, at: str, name: str) -> DataFrame:
    """Each probe row with the one of `values` (at, name; each `at` once) that is nearest in `at`, and the distance; of equals the smaller name.

    The nearest on either side come from windows over ranges of `at`, of about equally many rows; beyond a range's end
    stands the last or first value of the nearest range that has any, from a row per range.
    """
    in_range, _ = ranges_of(probe.select(at).unionByName(values.select(at)), at)
    rows = probe.withColumn("_v", F.lit(None).cast(T.StructType([T.StructField(at, values.schema[at].dataType), T.StructField(name, values.schema[name].dataType)])))
    both = rows.withColumn("_probe", F.lit(True)).unionByName(values.select(at, F.struct(at, name).alias("_v"), F.lit(False).alias("_probe")), allowMissingColumns=True)
    both = both.withColumn("_range", in_range)
    down, up = Window.partitionBy("_range").orderBy(at), Window.partitionBy("_range").orderBy(F.col(at).desc())
    last = lambda w: F.last("_v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ranges = both.groupBy(F.col("_range").alias("_r")).agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    whole = Window.partitionBy(F.lit(0))  # a bounded number of ranges
    beyond = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_r", beyond("_last", whole.orderBy("_r")).alias("_below"), beyond("_first", whole.orderBy(F.col("_r").desc())).alias("_above"))
    found = both.withColumns({"_low": last(down), "_high": last(up)}).where("_probe").join(ranges, F.col("_range") == F.col("_r"))
    beside = F.array(F.coalesce("_low", "_below"), F.coalesce("_high", "_above"))
    ranked = F.transform(F.filter(beside, lambda v: v.isNotNull()), lambda v: F.struct(F.abs(v[at] - F.col(at)).alias("distance"), v[name].alias(name)))
    return found.withColumn("_best", F.array_min(ranked)).select(*probe.columns, "_best.*")


def nearest_two(queries: DataFrame, codes: DataFrame, ratio: float, query_rows: int = 1024, rows: int = 16_384) -> DataFrame:
    """The two codes of all other rows (id, code) nearest to each query's by differing bits, of equals the smaller ids, and whether the first is clearly nearer.

    A stated query set against all rows, in blocks: both are packed in blocks of about so many rows; each block is sent
    to those of the other side by the pair's number, so they meet in an equi-join, and a pair of blocks gives each
    query's two best. Of these a window keeps two, of each task's before they are shuffled.
    """
    sides = {"q": (queries.where("code is not null"), query_rows), "c": (codes.where("code is not null"), rows)}
    n = {p: max(1, t.count() // size) for p, (t, size) in sides.items()}

    def packed(p: str, other: str) -> DataFrame:
        blocks = sides[p][0].groupBy(F.pmod(F.xxhash64("id"), F.lit(n[p])).alias(f"{p}_block")).agg(F.collect_list("id").alias(f"{p}_id"), F.collect_list("code").alias(f"{p}_code"))
        return blocks.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[other] - 1).cast("long"))))

    q, c = packed("q", "c"), packed("c", "q")
    blocks = q.join(c.withColumnRenamed("_other", "_mine"), (F.col("q_block") == F.col("_mine")) & (F.col("_other") == F.col("c_block")))

    def two_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_id, q, c_id, c = (batch.column(n)[i].values.to_numpy() for n in ("q_id", "q_code", "c_id", "c_code"))
                order = np.argsort(c_id, kind="stable")
                distance = np.bitwise_count(q.view(np.uint64)[:, None] ^ c[order].view(np.uint64)[None]).astype(np.int32)
                distance[q_id[:, None] == c_id[order][None]] = 1 << 20
                at = np.argsort(distance, axis=1, kind="stable")[:, :2]
                far, near = np.take_along_axis(distance, at, 1).ravel(), c_id[order][at].ravel()
                there = far < 1 << 20
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, at.shape[1])[there]), pa.array(far[there]), pa.array(near[there])], ["id", "distance", "other"])

    found = blocks.select("q_id", "q_code", "c_id", "c_code").mapInArrow(two_best, "id long, distance int, other long")
    near = Window.partitionBy("id").orderBy("distance", "other")
    two = found.withColumn("_n", F.row_number().over(near)).where("_n <= 2").groupBy("id").agg(*(F.max(F.when(F.col("_n") == i, F.struct("distance", "other"))).alias(name) for i, name in ((1, "a"), (2, "b"))))
    return two.select("id", F.col("a.other").alias("match"), F.col("a.distance").alias("distance"), F.col("b.distance").alias("second"), (F.col("a.distance") < ratio * F.col("b.distance")).alias("clear"))
