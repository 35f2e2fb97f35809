import zlib

import numpy as np
import pytest
from helpers import content, empty, odd, with_clashes
from pyspark.sql import functions as F

from cadenza.llm import catalog, quality, quality_rules, textstats

LABELS = "doc_id long, quality int, toxic int"


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.arange(5.0), np.array([4.0, 4, 4, 4, 4]), np.array([0.0, 2, 1, 4, 4]))
    assert (np.diff(y) >= 0).all()
    assert np.interp([0, 1, 2, 3], x, y).tolist() == [0, 0.375, 0.375, 1]


def test_normal_equations_equal_plain_sums(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((90, len(textstats.FEATURES))).astype(np.float32), rng.integers(0, 2, 90)
    df = spark.createDataFrame([(a.tolist(), int(b), 1) for a, b in zip(x, y, strict=True)], "_x array<float>, label int, fold int").repartition(5)
    from cadenza.llm.common import checkpoint

    model = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a, b, n = quality._normal_equations(checkpoint(df), model)
    z = model.fourier(x.astype(float))
    assert n == 90 and (a == z.T @ z).all() and (b == z.T @ y).all()


def test_held_out_accuracy(spark, sf_dir):
    rows = catalog.op1_quality(spark, sf_dir.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)


def test_odd_documents(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)] + [(None, 1, 0), (3, None, 0)], LABELS)
    out = quality.score(with_clashes(docs), labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert content(out) == content(quality.score(docs, labels))
    kept = quality.keep_good(with_clashes(docs), labels)
    assert kept.columns == with_clashes(docs).columns
    assert set(content(kept)) <= set(content(with_clashes(docs)))


def test_without_rows_or_labels(spark):
    assert {r.score for r in quality.score(odd(spark), empty(spark, LABELS)).collect()} == {0.5}
    assert quality.score(empty(spark), empty(spark, LABELS)).count() == 0
    assert quality.keep_good(empty(spark), empty(spark, LABELS)).count() == 0


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    return len(marked)


@pytest.mark.parametrize("long", [0, 20_000])
@pytest.mark.parametrize("seed", range(30))
def test_repeated_words(seed, long, monkeypatch):
    monkeypatch.setattr(textstats, "LONG_TEXT", long)
    rng = np.random.default_rng(seed)
    words = [bytes([97 + int(i)]) for i in rng.integers(0, 3, rng.integers(0, 25))]
    assert textstats.repeated_words(words) == plain_repeats(words)


def test_rules_on_odd_documents(spark):
    docs = odd(spark)
    out = quality_rules.judge(docs)
    assert out.count() == docs.count() and out.where("kept is null or base_failed is null or (base_failed and kept)").count() == 0
    assert content(quality_rules.judge(with_clashes(docs))) == content(out)
    kept = quality_rules.keep_clean(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns and kept.count() == out.where("kept").count()
    assert quality_rules.judge(empty(spark)).count() == 0 == quality_rules.keep_clean(empty(spark)).count()


def test_sketches_merge(spark):
    docs = quality_rules.with_stats(odd(spark))
    whole = quality_rules.sketches(docs)
    parts = quality_rules.sketches(docs.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(docs.where("doc_id % 2 <> 0 or doc_id is null")))
    assert content(parts.groupBy("lang", "source", "stat", "bucket").agg(F.sum("n").alias("n"))) == content(whole.select("lang", "source", "stat", "bucket", "n"))


def _sketch(spark, rows):
    return spark.createDataFrame([("en", s, k, b, n) for s, k, b, n in rows], "lang string, source string, stat string, bucket long, n long")


def test_a_group_of_any_size_moves_its_fence(spark):
    """Beside a large source, one of 10, 200 or 100,000 documents with longer words: the more it has, the farther its fence."""
    got = []
    for n in (0, 10, 200, 100_000):
        rows = [("large", k, b, m) for k in quality_rules.TAILS for b, m in ((100, 60_000), (140, 40_000))]
        rows += [("own", "word_len", b, n // 2) for b in (300, 340) if n]
        limits = {r.source: r for r in quality_rules.fences(_sketch(spark, rows)).collect()}
        got.append(limits["own"].fence_word_len if n else limits["large"].fence_word_len)
    assert got == sorted(set(got)) and abs(got[-1] - (340 + quality_rules.REACH * 40)) < 3


def test_rules_judge_each_group_by_its_own_fence(spark):
    rng = np.random.default_rng(1)

    def text(capitals):
        return " ".join("".join(rng.choice(list("abcdefgh"), 5)).capitalize() if rng.random() < capitals else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80))

    rows = [(i, text(0.05), "en", "calm", 1) for i in range(1500)] + [(3000 + i, text(0.9), "en", "titles", 1) for i in range(200)] + [(5000, text(0.9), "en", "calm", 1)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not kept[5000] and sum(kept[i] for i in range(1500)) > 1480 and sum(kept[3000 + i] for i in range(200)) > 190


def test_whole_query_against_plain_numpy(spark, sf_dir):
    """The classifier once more, on one machine: features, ridge on cosines, pooled calibration."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    remainder = lambda i, m=5: zlib.crc32(str(i).encode()) % m
    x = {d: np.array(textstats.features((t or "").encode()), np.float32).astype(float) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    known = [(x[d], int(q), remainder(d)) for d, q in zip(labels.doc_id, labels.quality, strict=True) if q == q and d in x and remainder(d)]
    every = np.array([k[0] for k in known])
    six = lambda v: np.array([float(f"{a:.6g}") for a in v])
    model = quality.Model(six(every.mean(axis=0)), six(every.std(axis=0)) + 1e-6)
    z, y = (np.array(v) for v in zip(*((model.fourier(a[None])[0], q) for a, q, f in known if f != 4), strict=True))
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    pools = []  # [last bin, rows, label 1] after rows of equal bins are taken together
    for b in sorted({round(float((model.fourier(a[None]) @ weights)[0] * quality.BINS)) for a, _, f in known if f == 4}):
        here = [q for a, q, f in known if f == 4 and round(float((model.fourier(a[None]) @ weights)[0] * quality.BINS)) == b]
        pools.append([[b, b], len(here), sum(here)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [[pools[-1][0][0], last[0][1]], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    at, share = (np.array(v) for v in zip(*((b / quality.BINS, p[2] / p[1]) for p in pools for b in p[0]), strict=True))
    expected = {d: float(np.interp((model.fourier(v[None]) @ weights)[0], at, share)) for d, v in x.items()}
    for r in catalog.op1_quality(spark, sf_dir).collect():
        assert abs(r.score - expected[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == (remainder(r.doc_id) == 0)


def test_texts_stay_where_they_are(spark, sf_dir, monkeypatch):
    """The fences go to the texts: the stage's plan exchanges nothing, at any size of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = quality_rules.keep_clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "hashpartitioning" not in plan and "Exchange hash" not in plan
    expected = quality_rules.keep_clean(docs).count()
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert quality_rules.keep_clean(docs).count() == expected


def test_labels_of_an_id_that_repeats(spark):
    """Equal labels count once, so an id that many documents and labels share makes no product."""
    x = spark.createDataFrame([(7, [0.0] * 18)] * 40, "doc_id long, _x array<float>")
    labels = spark.createDataFrame([(7, 1, 0)] * 50 + [(7, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    assert quality.training_rows(x, labels, "quality").count() in (0, 80)
    assert max(quality.training_rows(x.withColumn("doc_id", F.lit(i).cast("long")), labels.withColumn("doc_id", F.lit(i).cast("long")), "quality").count() for i in range(4)) == 80
