import random
import re

import numpy as np
import pytest
import xxhash
from helpers import DOCS, content, empty, odd, odd_rows, sentence, with_clashes

from cadenza.llm import catalog, components, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    prints = np.array(sorted(set(prints)), np.uint64)
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ p) <= distance]:
            parent[find(int(q))] = find(int(p))
    return {int(p): find(int(p)) for p in prints}


def test_ball():
    masks = simhash.ball(2)
    assert len(masks) == 2081 and np.bitwise_count(masks).max() == 2


def test_fingerprints_of_odd_texts():
    for row in odd_rows():
        if len(row[1] or "") < 50_000:
            assert simhash.fingerprint((row[1] or "").encode()) & (1 << 64) - 1 == plain(row[1])


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_brute_force_connects(spark, seed):
    rng = random.Random(seed)
    prints = [0]
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append(p)
            for _ in range(rng.randint(1, 6)):
                p ^= 1 << rng.randrange(64)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    star = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)))
    root = {r.node: r.root for r in star.collect()}
    expected = groups(prints)
    ours = {}
    for p in signed:
        ours.setdefault(root.get(p, p), set()).add(p & (1 << 64) - 1)
    theirs = {}
    for p, r in expected.items():
        theirs.setdefault(r, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 41)) and all(out[i] == 100 for i in range(101, 160)) and 7 in out
    assert components.components(empty(spark, "a long, b long")).count() == 0


def test_whole_query_against_brute_force(spark, sf_dir):
    rows = catalog.op2_simhash(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(text)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for d in list(text)[:60]:
        assert prints[d] == plain(text[d])
    root, least = groups(prints.values()), {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    assert all(r.component_id == least[root[prints[r.doc_id]]] for r in rows)


def test_odd_documents(spark):
    docs = odd(spark)
    out = simhash.near_duplicates(docs)
    assert out.count() == docs.count() and content(simhash.near_duplicates(with_clashes(docs))) == content(out)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in out.collect()}
    assert by[60, "0" * 16] == by[61, "0" * 16] == by[62, "0" * 16] == 60
    kept = simhash.keep_one(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 67 not in ids and 61 not in ids and 60 in ids and ids.count(0) == 1  # 67 copies 1; row 0 is there three times
    assert simhash.near_duplicates(empty(spark)).count() == 0 == simhash.keep_one(empty(spark)).count()


def test_keep_one_tells_rows_apart_by_id_and_content(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(sentence(rng, 9) for _ in range(4)) for _ in range(5))
    rows = [(None, None), (60, None), (None, a)]  # a null id linked to an id; an unlinked one
    rows += [(70, b), (71, b), (71, c)]  # id 71 twice, once in the component of 70
    rows += [(None, d), (None, d), (None, f"{d} "), (None, e)]  # a component without ids
    rows += [(80, e), (81, "x"), (81, "x")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(((i, t) for i, t in kept if i is not None), key=str) == sorted([(60, None), (70, b), (71, c), (80, e), (81, "x")], key=str)
    nameless = sorted((t.strip() for i, t in kept if i is None))
    assert nameless == sorted([a, d])
    assert (None, "a null id") in [(r.doc_id, r.text) for r in simhash.keep_one(odd(spark)).collect()]


@pytest.mark.parametrize("rows, kept", [
    ([(1, "A"), (None, "A"), (None, "B"), (5, "C")], [(1, "A"), (5, "C"), (None, "B")]),
    ([(1, "A"), (2, "A"), (2, "B"), (5, "C")], [(1, "A"), (2, "B"), (5, "C")]),
    ([(1, "A"), (1, "A"), (1, "A"), (None, "B"), (None, "B")], [(1, "A"), (None, "B")]),
])
def test_keep_one_loses_and_doubles_nothing(spark, rows, kept):
    docs = spark.createDataFrame([(i, f"{t} one two three four {t * 9}", "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    assert sorted(((r.doc_id, r.text[0]) for r in simhash.keep_one(docs).collect()), key=str) == sorted(kept, key=str)


def test_keep_one_of_a_row_that_a_third_repeats(spark):
    from pyspark.sql import functions as F

    hot = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("the same text in all of them").alias("text"))
    docs = hot.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [7, *range(100, 400)]


def test_keep_one_with_other_shingles_and_distance(spark):
    rng = random.Random(4)
    rows = []
    for i in range(0, 60, 3):
        words = sentence(rng, 150).split()
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-1])), (i + 2, " ".join(["new", *words[2:]]))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    kept = {}
    for size, distance in ((4, 4), (5, 2)):
        prints = {i: simhash.fingerprint(t.encode(), size) & (1 << 64) - 1 for i, t in rows}
        root, least = groups(prints.values(), distance), {}
        for i, p in prints.items():
            least.setdefault(root[p], i)
        kept[size] = sorted(r.doc_id for r in simhash.keep_one(docs, size, distance).collect())
        assert kept[size] == sorted(least.values())
    assert kept[4] != kept[5]
    with pytest.raises(ValueError):
        simhash.links(docs, 3)
