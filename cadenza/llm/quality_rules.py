"""Quality rules with thresholds that adapt to each language and source.

Every document gets whole-text counts. Six integer statistics of those that pass the base rule go into quantile
sketches per (lang, source, statistic): counts of values rounded up to where their seven leading bits change, so a
sketch has some hundred buckets, its quantiles are within 1/64, and sketches merge by adding counts (in any order, with the same
result). Merged over sources they give a language's quantiles, and over languages those of all.

No cutoff is fixed. A statistic's fence is its tail quantile and REACH times that quantile's distance from the median.
Both quantiles are a group's own, drawn towards its language's, which are drawn towards those of all, each with the
weight of PRIOR_DOCS documents: a group of any size moves its fence, the more the larger it is. Repetition is absent
from most documents and common in a few sound ones, so its tail is taken farther out. What over a tenth of a group's
documents share (a hundredth, for repetition) is the group's way of writing and no outlier there. The fences then
join the documents.

Defined cases: a null text has no words and fails the base rule; null lang and null source form groups of
their own; repeated rows are judged alike, each on its own; an empty table gives an empty result; extra
columns are kept by `keep_clean` and ignored by `judge`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, checkpoint, packed
from .textstats import SENTENCE_ENDS, base_stats, byte_counts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: statistic: percent of the documents below its tail.
TAILS = {"symbols": 90, "dups": 99, "repeats": 99, "upper": 90, "marks": 90, "word_len": 90}
REACH = 5
PRIOR_DOCS = 30
#: A table of groups' fences with at most so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 20_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_marks")
_STATS = T.StructType([T.StructField(f, T.LongType()) for f in _COUNTS])


def _counted(texts: list[bytes]) -> dict[str, pa.Array]:
    rows = []
    for text in texts:
        counts = byte_counts(text)
        rows.append((*base_stats(text, text.split(), counts), int(counts[65:91].sum()), int(counts[SENTENCE_ENDS].sum())))
    columns = np.array(rows, np.int64).reshape(-1, len(_COUNTS)).T
    return {"_stats": pa.StructArray.from_arrays([pa.array(c) for c in columns], list(_COUNTS))}


def with_stats(docs: DataFrame, name: str = "text") -> DataFrame:
    """`docs` and a struct column `_stats` of whole-text counts."""
    return append_columns(docs, name, [("_stats", _STATS)], _counted)


def _statistics(s: Column) -> dict[str, Column]:
    share = lambda part, whole, by=1000: F.floor(by * s[part] / F.greatest(s[whole], F.lit(1))).cast("long")
    return {
        "symbols": share("n_symbols", "word_chars", 100),
        "dups": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "word_len": share("word_chars", "n_words", 100),
    }


def _bucket(v: Column) -> Column:
    """The largest value with the seven leading bits of v."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 7, F.lit(0))).cast("long")
    return v - v % width + width - 1


def _failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, stat, bucket, n: the sketches of every group."""
    values = F.array(*(F.struct(F.lit(k).alias("stat"), _bucket(v).alias("bucket")) for k, v in _statistics(F.col("_stats")).items()))
    passed = stats.where(~_failed(F.col("_stats")))
    return passed.select("lang", "source", F.explode(values).alias("v")).groupBy("lang", "source", "v.stat", "v.bucket").agg(F.count("*").alias("n"))


def _quantiles(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat, n (documents), mid (median) and tail of every sketch."""
    up = Window.partitionBy(*keys, "stat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = table.withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "stat")))
    percent = F.create_map(*(F.lit(x) for kv in TAILS.items() for x in kv))[F.col("stat")]
    quantile = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("bucket")))
    return at.groupBy(*keys, "stat").agg(F.max("total").alias("n"), quantile(F.lit(50)).alias("mid"), quantile(percent).alias("tail"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with a fence for each statistic; made from sketches only."""
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch.groupBy("lang", "stat", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    all_ = _quantiles(sketch.groupBy("stat", "bucket").agg(F.sum("n").alias("n")), [])
    drawn = lambda value, n, to: (F.col(value) * F.col(n) + PRIOR_DOCS * F.col(to)) / (F.col(n) + PRIOR_DOCS)
    all_ = all_.select("stat", F.col("mid").alias("all_mid"), F.col("tail").alias("all_tail"))
    lang = lang.join(F.broadcast(all_), "stat")  # a row per statistic
    lang = lang.select(F.col("lang").alias("_l"), F.col("stat").alias("_s"), drawn("mid", "n", "all_mid").alias("lang_mid"), drawn("tail", "n", "all_tail").alias("lang_tail"))
    near = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("stat") == F.col("_s")))
    near = near.withColumn("_mid", drawn("mid", "n", "lang_mid")).withColumn("_tail", drawn("tail", "n", "lang_tail"))
    near = near.withColumn("fence", F.col("_tail") + REACH * (F.col("_tail") - F.col("_mid")))
    return near.groupBy("lang", "source").agg(*(F.max(F.when(F.col("stat") == k, F.col("fence"))).alias(f"fence_{k}") for k in TAILS))


def _verdict(stats: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """`stats` with _failed and _kept. `limits` is checkpointed, so its count is cheap."""
    s = F.col("_stats")
    few = limits.count() <= BROADCAST_ROWS
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    limits = F.broadcast(limits) if few else limits
    joined = stats.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k, v in _statistics(s).items():
        inside = inside & (v <= F.col(f"fence_{k}"))
    return joined.withColumn("_failed", _failed(s)).withColumn("_kept", ~F.col("_failed") & inside)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document. The text is read once; counts are kept in a checkpoint."""
    stats = checkpoint(with_stats(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    counts = [F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return _verdict(stats, checkpoint(fences(sketches(stats)))).select("doc_id", *counts, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    Counts are made twice (for the sketches and for the filter): that costs less than moving the texts. The fences go
    to the texts, unless there are more groups than BROADCAST_ROWS.
    """
    limits = checkpoint(fences(sketches(with_stats(docs.select("lang", "source", "text")))))
    return _verdict(with_stats(packed(docs), "_doc.text"), limits, "_doc.lang", "_doc.source").where("_kept").select("_doc.*")
