"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space (Java, DuckDB and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the filter that `possible` sends to executors.
FILTER_BITS = 1 << 24

#: Bytes of an Arrow batch, where the session does not say otherwise. Rows alone bound none: 10,000 texts may take any room.
BATCH_BYTES = 4 << 20

#: Folders that this process has written between steps.
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master (tests) may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder for intermediate data, in the shared one."""
    _staged.append(f"{shared_dir(spark)}/cadenza/{uuid.uuid4().hex}")
    return _staged[-1]


def drop_staged(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Remove what was staged from the `first` on, but for the last `keep`: once a query's result is written, nothing of it is needed."""
    paths = _staged[first : len(_staged) - keep]
    del _staged[first : len(_staged) - keep]
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; it outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """A written copy of `df` in the shared folder, read again: like `checkpoint`, but by column and without a partitioning.

    A join with it shuffles both sides, so that Spark can split a partition that a hot key makes large. What was shuffled
    to make it goes from the disk as soon as it is written.
    """
    path = new_folder(df.sparkSession)
    with configured(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The staged result of `make`; what was staged to make it is removed."""
    first = len(_staged)
    out = stage(make())
    drop_staged(spark, first, keep=1)
    return out


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """`key` set to `value` in the block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold about BATCH_BYTES, unless it sets a size of its own.

    It stays set, as plans are run after they are made. Tasks, their workers and the allocators of both keep the room of
    the largest batch they have seen.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def possible(df: DataFrame, hashes: DataFrame, name: str) -> DataFrame:
    """`df` and a boolean column _possible: false where its long column `name`, a hash, is surely not in the only column of `hashes`.

    What is true still needs an exact join; what is false need not be shuffled for it, however wide. The filter is sent
    as words of 64 bits, at most FILTER_BITS / 64 rows for any number of hashes; where it fills up, more is true.
    """

    def word(hash_: Column) -> Column:
        return F.shiftright(hash_.bitwiseAND(F.lit(FILTER_BITS - 1)), 6)

    def bit(hash_: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), hash_.bitwiseAND(F.lit(63)).cast("int"))

    own, other = F.col(name), F.col(hashes.columns[0])
    words = stage(hashes.groupBy(word(other).alias("_word")).agg(F.bit_or(bit(other)).alias("_bits")))
    joined = df.join(F.broadcast(words), word(own) == F.col("_word"), "left")
    return joined.select(*df.columns, F.coalesce(F.col("_bits").bitwiseAND(bit(own)) != 0, F.lit(False)).alias("_possible"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(docs: DataFrame) -> DataFrame:
    """`docs` as one struct column _doc, so that no name of theirs meets one of ours; `select("_doc.*")` undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def append_columns(
    df: DataFrame, name: str, fields: list[tuple[str, T.DataType]], compute: Callable[[list[bytes]], dict[str, pa.Array]]
) -> DataFrame:
    """`df` with the columns `fields` that `compute` makes from the texts of column `name`, batch by batch.

    `name` may be a field of a struct, as in _doc.text. Other columns pass through as they are; `fields` must not
    clash with them.
    """
    clash = {f for f, _ in fields} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f, t) for f, t in fields)])
    names, path = [f for f, _ in fields], name.split(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(path[0]))
            made = compute(texts(pc.struct_field(column, path[1:]) if path[1:] else column))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[f] for f in names)], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def merged_sums(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of an array of doubles that `of` makes from each batch; `shape` must not depend on the rows.

    Each partition adds up its own, some partitions' sums are added in a task each, and the driver adds those.
    """
    slots = max(1, math.isqrt(df.rdd.getNumPartitions()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % slots], pa.int32()), "sums": [total.tobytes()]})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"slot": table.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    found = df.mapInArrow(partial, "slot int, sums binary").groupBy("slot").applyInArrow(merge, "slot int, sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(math.prod(shape))).reshape(shape)
