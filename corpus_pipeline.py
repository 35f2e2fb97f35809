"""From raw documents to packed sequences: quality, rules, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as Parquet in the shared folder
and gives the next one what it reads back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import mixing, packing, quality, quality_rules, simhash
from cadenza.llm.common import finished, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return quality_rules.keep_clean(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by fingerprint, and by five-word shingles of similarity 0.8 or more."""
    return simhash.keep_one(docs, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("simhash near-dedup", dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the classifier and the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = finished(spark, lambda step=step, docs=docs: step(spark, docs, sf_dir))
    return docs
