import itertools
import random

import numpy as np
import pytest
from helpers import DOCS, empty, odd, sentence, with_clashes
from pyspark.sql import functions as F

from cadenza.llm import common, minima, simhash
from cadenza.llm.common import append_columns, configured, possible, read, stage


def sets(texts):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    return out


def similar(texts, least=0.8):
    """All pairs by number, with their exact similarity."""
    s = sets(texts)
    pairs = ((i, j, len(s[i] & s[j]) / max(len(s[i] | s[j]), 1)) for i, j in itertools.combinations(range(len(s)), 2))
    return [p for p in pairs if p[2] >= least]


def reach(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return find


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def found(spark, texts, similarity=0.8):
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    sketched = stage(append_columns(rows, "text", minima.FIELDS, minima.sketches))
    return sorted((r.a, r.b) for r in minima.verified(minima.candidates(sketched, similarity), rows, similarity).collect())


def test_shingles_and_jaccard_of_texts():
    rng = random.Random(5)
    base = sentence(rng, 300).split()
    texts = [edited(rng, base, n) for n in (0, 3, 30)] + ["", "one two", "ONE two", "a a a a a a a a"]
    hashed = [minima.shingles(t.encode()) for t in texts]
    assert [len(h) for h in hashed] == [len(s) for s in sets(texts)]
    for i, j, s in similar(texts, 0):
        assert minima.jaccard(hashed[i], hashed[j]) == pytest.approx(s)
    long = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3 * minima._CHUNK, np.uint64))
    masks, factors = minima._orders()
    plain = [min(long.tolist(), key=lambda h, m=int(m), f=int(f): (h ^ m) * f % (1 << 64)) for m, f in zip(masks[:8, 0], factors[:8, 0], strict=True)]
    assert minima.minima(long, minima._orders())[:8].tolist() == plain


def test_forest_joins_what_the_estimates_join():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (5, minima.MINIMA), np.uint8)[rng.integers(0, 5, 60)]
    noise = rng.random(rows.shape) < rng.random((60, 1)) * 0.4
    rows = np.where(noise, rng.integers(0, 256, rows.shape), rows).astype(np.uint8)
    links = minima.forest(np.arange(60) + 100, rows, 180)
    pairs = [(i + 100, j + 100) for i, j in itertools.combinations(range(60), 2) if (rows[i] == rows[j]).sum() >= 180]
    ours, theirs = reach(links), reach(pairs)
    assert links and len(links) < 60 and set(links) <= {p for q in pairs for p in (q, q[::-1])}
    assert all((ours(i) == ours(j)) == (theirs(i) == theirs(j)) for i, j in itertools.combinations(range(100, 160), 2))


@pytest.mark.parametrize("block", [minima.BLOCK, 4])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minima, "BLOCK", block)
    rng = random.Random(7)
    texts = ["", None, "one two", "ONE  two"]
    for group in [25] + [rng.randint(1, 4) for _ in range(40)]:
        base = sentence(rng, rng.randint(60, 240)).split()
        texts += [edited(rng, base, rng.randint(0, len(base) // 40)) for _ in range(group)]
    pairs, links = similar(texts), found(spark, texts)
    exact = {(i, j) for i, j, _ in pairs}
    assert (2, 3) in links and set(links) <= exact
    joined = reach(links)
    assert len(pairs) > 100 and sum(joined(i) == joined(j) for i, j, _ in pairs) >= 0.97 * len(pairs)


def test_keep_one_of_similar_documents(spark):
    rng = random.Random(9)
    rows, kept = [], []
    for i in range(0, 120, 4):
        base = sentence(rng, 200).split()
        near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (50, 150)]  # similarities .95 and .90
        rows += [(i, " ".join(base)), (i + 1, near[0]), (i + 2, near[1]), (i + 3, edited(rng, base, 40))]
        kept += [i, i + 3]
    docs = with_clashes(spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)).repartition(3)
    out = simhash.keep_one(docs, similarity=0.8)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == kept
    assert simhash.keep_one(docs).count() > len(kept)


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    rng = random.Random(13)
    base = [sentence(rng, 80) for _ in range(60)]
    rows = [*enumerate(base), *((1000 + i, base[i]) for i in range(6)), (500, base[7]), (500, base[7]), (9, base[9])]
    spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS).write.parquet(f"{tmp_path}/docs")
    with configured(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
        assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    plan = out._jdf.queryExecution().executedPlan().toString()
    stays = plan[: plan.index("SortMergeJoin")]
    assert "FileScan" in stays and "hashpartitioning" not in stays


def test_possible_misses_nothing(spark, monkeypatch):
    for bits, most in ((1 << 24, 20), (1 << 10, 3000)):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(-1, -1), (-2, None)], "id long, h long"))
        made = possible(rows, rows.where("id % 200 = 7 or id = -1").select("h"), "h").where("_possible").collect()
        some = {r.id for r in made}
        assert made[0].__fields__ == ["id", "h", "_possible"] and some >= {-1, *range(7, 20_000, 200)} and -2 not in some and len(made) < 101 + most
    assert possible(rows, rows.where("false").select("h"), "h").where("_possible").count() == 0


def test_keep_one_of_odd_documents(spark):
    docs = odd(spark)
    plain, out = (sorted(str(r) for r in simhash.keep_one(docs, similarity=s).collect()) for s in (None, 0.8))
    assert set(out) <= set(plain) and any("doc_id=60," in r for r in out) and len(out) == len(set(out))
    assert simhash.keep_one(empty(spark), similarity=0.8).count() == 0


def test_recall_on_the_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text)
    kept = {r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()}
    pairs = similar([text[i] for i in ids])
    both = sum(ids[i] in kept and ids[j] in kept for i, j, _ in pairs)
    assert pairs and both <= 0.02 * len(pairs)
    alone = set(ids) - {ids[k] for i, j, _ in similar([text[i] for i in ids], 0.4) for k in (i, j)}
    assert alone and all(i in kept for i in alone)
