"""Logs, documents and folders as DataFrames, and reports as files; all through Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in a row of `pcm`.
BLOCK = 65_536


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, by a closed schema: an unknown or malformed one fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tracks(df: DataFrame, formats: str) -> DataFrame:
    """The first video and the first audio track of documents with an array of {vcodec, acodec, url}."""
    first = lambda codec: F.get(F.filter(formats, lambda t: F.coalesce(t[codec], F.lit("none")) != "none"), F.lit(0))["url"]
    return df.select("*", first("vcodec").alias("video"), first("acodec").alias("audio"))


def matching_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file and line of a log's lines that match; the pattern's groups are in `parts`."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(pattern)).withColumn("parts", F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size and time of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), "modificationTime")


def pcm(spark: SparkSession, path: str, rate: int, block: int = BLOCK) -> DataFrame:
    """Mono little-endian float samples of raw files: path, first (sample), seconds of it, and values of up to `block` samples.

    A file comes whole to one task, as binary files do in Spark, which ends at 2 GiB of it. A last sample that is cut fails.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if raw.size % 4:
                    raise ValueError(f"{name} ends inside a sample")
                values = np.frombuffer(raw, "<f4")
                for first in range(0, len(values), block):
                    one = pa.ListArray.from_arrays([0, len(values[first : first + block])], pa.array(values[first : first + block], pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), one], ["path", "first", "values"])

    out = files.mapInArrow(run, "path string, first long, values array<float>")
    return out.select("path", "first", (F.col("first") / rate).alias("seconds"), "values")


def joined_chunks(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """Parquet chunks in order of name, with their number; another number of files than expected is an error."""
    df = spark.read.parquet(path).withColumn("chunk", F.col("_metadata.file_name"))
    n = df.select("chunk").distinct().count()
    if n != expected:
        raise ValueError(f"{n} chunks in {path}, not {expected}")
    return df.orderBy("chunk")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row with its nulls; never over an old one."""
    report.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def latest(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """A stream's newest row of each key, for `newest` to read: the last value wins.

    Each micro-batch adds its own newest rows in a folder of its number, so it writes what has changed, readers always
    find a whole state, and a batch that is run again takes its own place.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows = F.struct(*[c for c in stream.columns if c not in keys])

    def add(batch: DataFrame, number: int) -> None:
        publish(batch.groupBy(*keys).agg(F.max_by(rows, order).alias("r")).select(*keys, "r.*"), number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def newest(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """What `latest` has written: one row per key, that with the highest `order`, of equals the one that came last."""
    rows = spark.read.parquet(path)
    kept = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(kept, F.struct(order, "batch")).alias("r")).select(*keys, "r.*")


def compacted(spark: SparkSession, path: str, keys: list[str], order: str) -> None:
    """Put the newest rows of all batches but the last in the place of the last but one; for a stream that stands still."""
    batches = sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect())  # a row per batch
    if len(batches) < 3:
        return
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    base = spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches[:-1]))
    kept = F.struct(*[c for c in base.columns if c not in (*keys, "batch")])
    base.groupBy(*keys).agg(F.max_by(kept, F.struct(order, "batch")).alias("r")).select(*keys, "r.*").write.parquet(f"{path}/_compacted")
    fs.delete(at(f"batch={batches[-2]}"), True)
    fs.rename(at("_compacted"), at(f"batch={batches[-2]}"))
    for b in batches[:-2]:
        fs.delete(at(f"batch={b}"), True)
