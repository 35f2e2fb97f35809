"""Each stage against what its operator decides on the stage's own input."""

from pyspark.sql import functions as F
from test_minima import reach, similar

import corpus_pipeline
from cadenza.llm import mixing, quality, quality_rules, simhash
from cadenza.llm.common import read, stage


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, labels = docs.columns, read(spark, sf_dir, "labels")
    steps = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stage(steps[0](spark, docs, sf_dir))
    assert good.columns == columns and ids(good) == ids(quality.score(docs, labels).where("predicted = 1"))
    clean = stage(steps[1](spark, good, sf_dir))
    assert clean.columns == columns and ids(clean) == ids(quality_rules.judge(good).where("kept"))
    unique = stage(steps[2](spark, clean, sf_dir))
    text = {r.doc_id: r.text for r in clean.join(simhash.near_duplicates(clean).select(F.col("component_id").alias("doc_id")).distinct(), "doc_id").collect()}
    firsts = sorted(text)
    root = reach((firsts[j], firsts[i]) for i, j, _ in similar([text[i] for i in firsts]))
    groups = {}
    for i in firsts:
        groups.setdefault(root(i), []).append(i)
    assert unique.columns == columns and ids(unique) == sorted(map(min, groups.values()))
    mixed = stage(steps[3](spark, unique, sf_dir))
    taken = mixing.shares(unique).where("taken > 0").collect()
    assert mixed.columns == columns and ids(mixed) == sorted(r.doc_id for r in taken for _ in range(r.taken // r["size"]))
    packed = steps[4](spark, mixed, sf_dir)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
