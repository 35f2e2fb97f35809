import math
import zlib

import numpy as np
import pytest
from helpers import content, empty, odd, odd_rows, with_clashes

from cadenza.llm import catalog, knn, token_counts, toxicity, urls, warc

PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    from oracle import same

    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


# Token counts


def plain_count(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        char = len(word[end - 1].encode())
        options = [(best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] + char)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best.append(min(options, key=lambda o: (-o[0], o[1])))
    return best[-1][1]


def test_trie_equals_plain_programming(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_NODES", 50)  # it starts anew again and again
    scores = token_counts.vocabulary(token_counts.default_model())
    trie = token_counts.Trie(scores)
    words = [token_counts.MARK + w for r in odd_rows() for w in (r[1] or "").split()[:40]]
    assert [trie.count(w) for w in words] == [plain_count(w, scores) for w in words]


def test_trie_equals_a_unigram_model():
    from tokenizers import Tokenizer, models

    scores = token_counts.vocabulary(token_counts.default_model())
    reference = Tokenizer(models.Unigram([("<unk>", -1000.0), *scores.items()], 0))
    trie = token_counts.Trie(scores)
    for word in ["▁the", "▁nation", "▁tokenisation", "▁unbelievably", "▁zzzzqq", "▁éclair"]:
        assert trie.count(word) == len(reference.encode(word).ids)


def test_token_counts_of_odd_documents(spark):
    scores = token_counts.vocabulary(token_counts.default_model())
    out = token_counts.count_tokens(with_clashes(odd(spark))).collect()
    expected = sorted((str(r[0]), len((r[1] or "").encode().split()), sum(plain_count(token_counts.MARK + w.decode(), scores) for w in (r[1] or "").encode().split())) for r in odd_rows() if len(r[1] or "") < 50_000)
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in out if r.n_pretokens < 20_000)
    assert got == expected and len(out) == len(odd_rows())
    assert token_counts.count_tokens(empty(spark)).count() == 0


@pytest.mark.parametrize("long", [5, 17, 40])
def test_words_beyond_the_trie(monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    scores = token_counts.vocabulary(token_counts.default_model())
    trie = token_counts.Trie(scores)
    words = [token_counts.MARK + w for w in ["internationalisation" * 4, "x" * 41, "nation" * 9 + "é中", "the", "a" * long, "a" * (long - 1)]]
    assert [trie.count(w) for w in words] == [plain_count(w, scores) for w in words]


def test_a_very_long_word_makes_few_nodes():
    trie = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    word = "abcdefghij" * 40_000
    assert trie.count(word) == trie.count(word) > 40_000
    assert len(trie.children) <= token_counts.LONG + 1 and word not in trie.terminal


def test_long_words_are_not_kept(spark, monkeypatch):
    """Words that share their first characters make few nodes; none of them may stay in memory, and counts stay the same."""
    head = "abcdefghij" * 200
    words = [f"{head}{'xyz' * 20}{i}" for i in range(2_000)]
    assert min(map(len, words)) > token_counts.LONG
    docs = spark.createDataFrame([(i, " ".join(words[i::50])) for i in range(50)], "doc_id long, text string")
    monkeypatch.setattr(token_counts, "_trie", lambda path: trie)
    trie = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    found = []
    monkeypatch.setattr(token_counts, "append_columns", lambda df, name, fields, compute: found.append(compute) or df)
    token_counts.count_tokens(docs)
    made = found[0]([" ".join(words).encode()])
    assert trie.terminal == {"": 0} and trie.held == 0
    fresh = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    assert made["n_tokens"].to_pylist() == [sum(fresh.count(token_counts.MARK + w) for w in words)]
    monkeypatch.setattr(token_counts, "MAX_BYTES", 1000)
    some = [w.encode() for w in ("alpha beta gamma delta " * 3 + " ".join(f"w{i}" for i in range(500))).split()]
    assert found[0]([b" ".join(some)])["n_tokens"].to_pylist() == [sum(fresh.count(token_counts.MARK + w.decode()) for w in some)]
    assert trie.held <= 1000 + 2 * max(map(len, some)) + 3


# Toxicity


def plain_score(net, text):
    """The highest window probability of a text, number by number, by loops alone."""
    words = toxicity.words_of(text)
    if not words:
        words = [None]
    best, sigmoid, p, h = -math.inf, lambda v: 1 / (1 + math.exp(-v)), net.p, toxicity.HIDDEN
    begins = [b for b in range(0, len(words), toxicity.STRIDE) if b == 0 or b + toxicity.WINDOW - toxicity.STRIDE < len(words)]
    for begin in begins:
        inputs = []
        for w in words[begin : begin + toxicity.WINDOW]:
            if w is None:
                continue
            lexicon = toxicity.Lexicon()
            lexicon.add([w])
            inputs.append([float(v) for v in net.inputs(lexicon)[0]])
        ways = []
        for way in "fb":
            state, states = [0.0] * h, []
            for x in inputs if way == "f" else inputs[::-1]:
                left = [sum(x[i] * float(p[f"W{way}"][i, j]) for i in range(len(x))) + float(p[f"c{way}"][j]) for j in range(3 * h)]
                right = [sum(state[i] * float(p[f"U{way}"][i, j]) for i in range(h)) for j in range(3 * h)]
                z, r = ([sigmoid(left[k * h + j] + right[k * h + j]) for j in range(h)] for k in (0, 1))
                new = [math.tanh(left[2 * h + j] + r[j] * right[2 * h + j]) for j in range(h)]
                state = [z[j] * state[j] + (1 - z[j]) * new[j] for j in range(h)]
                states.append(state)
            ways.append(states if way == "f" else states[::-1])
        hidden = [f + b for f, b in zip(*ways, strict=True)]
        energy = [sum(float(p["v"][j]) * math.tanh(sum(s[i] * float(p["A"][i, j]) for i in range(2 * h)) + float(p["a"][j])) for j in range(h)) for s in hidden]
        total = sum(math.exp(e - max(energy)) for e in energy)
        pooled = [sum(math.exp(e - max(energy)) / total * s[i] for e, s in zip(energy, hidden, strict=True)) for i in range(2 * h)]
        best = max(best, sum(pooled[i] * float(p["w"][i]) for i in range(2 * h)) + float(p["o"][0]))
    return sigmoid(best)


def test_network_equals_plain_loops():
    net, rng = toxicity.Network(), np.random.default_rng(1)
    for k in ("word", "o", "a", "cf", "cb", "w"):
        net.p[k] = rng.normal(0, 0.7, net.p[k].shape).astype(np.float32)
    documents = [b"", b"one", b"One two, two three! four", " ".join(f"w{i % 17}" for i in range(70)).encode(), "ÄÖ é 中文".encode(), b"x " * 113]
    got = net.scores([toxicity.words_of(t) for t in documents])
    assert np.allclose(got, [plain_score(net, t) for t in documents], atol=1e-5)


def test_gradients():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    table, at, y = rng.normal(size=(20, 16)), rng.integers(0, 20, (5, 7)), np.array([1, 0, 1, 0, 1.0])
    mask = (np.arange(7) < np.array([7, 3, 5, 1, 6])[:, None]).astype(float)

    def loss():
        p = toxicity._sigmoid(net.forward(table, at, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found, d_table = net.gradients(table, at, mask, y)
    for array, gradient in [(net.p[k], found[k]) for k in ("Wf", "Ub", "cf", "A", "a", "v", "w", "o")] + [(table, d_table)]:
        i = tuple(int(rng.integers(0, s)) for s in array.shape)
        held = array[i]
        array[i] = held + 1e-3
        up = loss()
        array[i] = held - 1e-3
        down = loss()
        array[i] = held
        assert abs((up - down) / 2e-3 - gradient[i]) < 1e-5 + 1e-2 * abs(gradient[i])


def test_windows_cover_every_word():
    for lengths in ([0], [1, 64, 65, 0, 200], [112, 113]):
        doc, start, size = toxicity.windows(lengths)
        covered = [set() for _ in lengths]
        for d, s, n in zip(doc, start - np.repeat(np.cumsum(lengths) - lengths, np.bincount(doc, minlength=len(lengths))), size, strict=True):
            covered[d] |= set(range(s, s + n))
        assert [len(c) for c in covered] == lengths


def made(n, seed):
    rng = np.random.default_rng(seed)
    common, bad = [f"w{i}" for i in range(400)], ["vile", "rotten", "dreadful"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choice(common, 120).tolist()
        if i % 3 == 0:
            for _ in range(4):
                words.insert(int(rng.integers(0, 100)), str(rng.choice(bad)))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_network_learns():
    texts, labels = made(500, 1)
    net = toxicity.train([t.encode() for t in texts], np.array(labels))
    new, truth = made(150, 2)
    got = net.scores([toxicity.words_of(t.encode()) for t in new]) >= toxicity.THRESHOLD
    assert (got == np.array(truth, bool)).mean() > 0.95
    alone = net.scores([toxicity.words_of(new[0].encode())])[0]
    assert abs(alone - net.scores([toxicity.words_of(t.encode()) for t in new])[0]) < 1e-5


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(with_clashes(odd(spark)), labels)
    assert out.count() == len(odd_rows()) and out.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    none = toxicity.score(odd(spark), empty(spark, "doc_id long, quality int, toxic int"))
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.score(empty(spark), labels).count() == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "FIT_POSITIVE", 3)
    monkeypatch.setattr(toxicity, "FIT_NEGATIVE", 5)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.repeat(F.lit("long "), 2_000)).otherwise(F.lit("short")).alias("text"))
    docs = docs.unionByName(spark.range(20_000).select(F.lit(ids[-1]).cast("long").alias("doc_id"), F.lit("the same id again and again").alias("text")))
    docs = docs.unionByName(spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), toxicity.MOST_BYTES + 1).alias("text")))
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 8 and set(r.doc_id for r in rows) <= set(ids)
    assert [len(r.text) for r in rows if r.label] == [10_000] * 3  # no short ones: longer ones take their place
    assert {len(r.text) for r in rows if not r.label} == {5}


def test_toxicity_of_sf_documents_one_by_one(spark, sf_dir):
    """The query's scores are the network's of each text alone, and separate the held-out documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in catalog.op7_toxicity(spark, sf_dir).collect()}
    net = toxicity.fit(docs, labels)
    for r in docs.limit(40).collect():
        assert abs(net.scores([toxicity.words_of((r.text or "").encode())])[0] - out[r.doc_id].score) < 1e-5


# URLs


def test_urls(spark):
    rows = [(1, "https://WWW.Example.COM/en/70?x", "allow"), (2, "http://a.com/en/1", "block"), (3, "http://example.com/en/7", "allow"), (4, "http://badexample.com/en/7", "block"), (5, "http://example.net/de/8x", "block"), (6, "http://x.net/de/8", "allow"), (7, "no scheme/en/", "allow"), (8, None, "allow"), (9, "", "allow"), (None, "ftp://o.org/es/#f", "block"), (2, "http://a.com/en/1", "block"), (10, "http://h?x=/en/", "allow")]
    pages = spark.createDataFrame([r[:2] + ("",) for r in rows], PAGES)
    out = urls.judge(with_clashes(pages))
    assert sorted((str(r.page_id), r.verdict) for r in out.collect()) == sorted((str(a), v) for a, _, v in rows)
    by = {r.page_id: r for r in out.collect()}
    assert (by[1].host, by[1].path, by[1].rule) == ("www.example.com", "/en/70", "example.com/en/7")
    assert (by[10].host, by[10].path, by[10].rule) == ("h", "", None) and (by[8].host, by[8].path) == ("", "")
    assert urls.judge(empty(spark, PAGES)).count() == 0


def test_templates_reject_what_labels_say(spark):
    rows = [(i, f"http://shop.org/{'ad' if i % 2 else 'art'}/{i}/{'x' if i % 3 else 'y'}", "") for i in range(400)]
    rules = [("block", "shop.org", f"/ad/{i}/x") for i in range(1, 60, 2)] + [("allow", "shop.org", f"/art/{i}") for i in range(0, 60, 2)]
    out = urls.judge(spark.createDataFrame(rows, PAGES), rules).where("rule is null").collect()
    shapes = {(r.path.split("/")[1], r.path.split("/")[3]): set() for r in out}
    for r in out:
        shapes[r.path.split("/")[1], r.path.split("/")[3]].add(r.verdict)
    assert shapes["ad", "x"] == {"block"} and shapes["art", "x"] == shapes["art", "y"] == {"allow"}


def test_the_deepest_segment_alone_decides(spark):
    rows = [(i, f"http://shop.org/a/b/c/d/e/{'ad' if i % 2 else 'art'}/{i}", "") for i in range(200)]
    rules = [("block", "shop.org", f"/a/b/c/d/e/ad/{i}") for i in range(1, 60, 2)] + [("allow", "shop.org", f"/a/b/c/d/e/art/{i}") for i in range(0, 60, 2)]
    rows += [(1000 + i, f"http://shop.org/{i % 7}/w{i}x/{'y' * (i % 3)}/z{i % 5}/v/{i}", "") for i in range(80)]
    out = urls.judge(spark.createDataFrame(rows, PAGES), rules).where("rule is null").collect()
    assert all((r.verdict == "block") == ("/ad/" in r.path) for r in out) and any(r.verdict == "block" for r in out)


def test_similar_branches_merge(spark):
    """Shares of .39 and .41 are one branch; of many labels, .41 and .59 are two. A uniform node is a branch among its siblings."""
    rows = [("h", ["/a"], 100, 39), ("h", ["/b"], 100, 41), ("i", ["/a"], 1000, 410), ("i", ["/b"], 1000, 590), ("i", ["/c"], 0, 0)]
    rows += [("j", ["/a", "/a/x"], 4, 4), ("j", ["/a", "/a/y"], 4, 4), ("j", ["/b"], 4, 4), ("j", ["/c", "/c/x"], 50, 0), ("j", ["/c", "/c/y"], 50, 50), ("j", ["/d", "/d/x", "/d/x/x"], 3, 0)]
    out = {(r.host, r.template): (r.labels, r.blocked) for r in urls._branches(spark.createDataFrame(rows, "host string, up array<string>, labels long, blocked long")).collect()}
    assert out == {
        ("h", "/a"): (200, 80), ("h", "/b"): (200, 80), ("i", "/a"): (1000, 410), ("i", "/b"): (1000, 590),
        ("j", "/a"): (12, 12), ("j", "/b"): (12, 12), ("j", "/d"): (3, 0), ("j", "/c/x"): (50, 0), ("j", "/c/y"): (50, 50),
    }


@pytest.mark.parametrize("seed", range(2))
def test_tree_equals_sql_on_deep_paths(spark, tmp_path, seed):
    import duckdb
    from oracle import rows as in_order

    rng = np.random.default_rng(seed)
    heads = ["en", "de", "es"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(6000):
        host = str(rng.choice(["a.com", "b.example.com", "c.net", "d.org"]))
        deep = [str(rng.choice([f"s{rng.integers(4)}", f"u{rng.integers(200)}x", str(rng.integers(1000))])) for _ in range(rng.integers(0, 5))]
        rows.append((i, f"http://{host}/{'/'.join([str(rng.choice(heads)), *deep])}", ""))
    rows += [(9000, "http://a.com", ""), (9001, "http://a.com/", ""), (9002, "http://a.com//en//", ""), (9003, None, "")]
    pages = spark.createDataFrame(rows, PAGES)
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    made, out = c.sql(catalog.ORACLES["op4_urls"]), urls.judge(pages)
    got = in_order(out.columns, [tuple(r) for r in out.collect()])
    assert got == in_order(made.columns, made.fetchall())
    assert out.where("rule is null and verdict = 'block'").count() > 10


# WARC


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    warc.register(spark)
    rows = [(f"<r{i}>", "revisit" if i % 3 == 0 else "response", f"http://h/\r\n{i}" if i else None, f"<r{i - 1}>" if i % 3 == 0 else None, None, i, bytes(range(256)) * (i % 5 * 40)) for i in range(30)]
    path = str(tmp_path / "w")
    spark.createDataFrame(rows, warc.RECORD).repartition(3).write.format("warc").option("compression", compression).mode("append").save(path)
    back = {r.record_id: r for r in spark.read.format("warc").load(path).collect()}
    assert len(back) == 30 and all(bytes(back[r[0]].payload) == r[6] and back[r[0]].record_type == r[1] for r in rows)
    assert back["<r1>"].target_uri == "http://h/%0D%0A1" and back["<r0>"].target_uri is None
    some = spark.read.format("warc").load(path).where("record_type = 'revisit' and refers_to is not null")
    assert some.count() == 10 and "Filter (" not in some._jdf.queryExecution().executedPlan().toString()  # all of it is pushed down
    heads = spark.read.format("warc").schema("record_id string, payload_bytes long").load(path)
    assert sorted(r.payload_bytes for r in heads.collect()) == list(range(30))
    spark.createDataFrame(rows[:2], warc.RECORD).write.format("warc").option("compression", compression).mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 2


def _records(n):
    return [{"record_id": f"<r{i}>", "record_type": "revisit" if i % 3 == 0 else "response", "payload_bytes": i, "payload": bytes(range(256)) * (i % 5 * 700)} for i in range(n)]


class _Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        import io

        self.io, self.read_bytes, self.length = io.BytesIO(data), 0, len(data)

    def read(self, n):
        out = self.io.read(min(n, 256))
        self.read_bytes += len(out)
        return out

    def tell(self):
        return self.io.tell()

    def seek(self, at):
        self.io.seek(at)

    def size(self):
        return self.length


def test_rejected_payloads_are_not_inflated():
    import gzip

    rng = np.random.default_rng(0)
    big = [{"record_id": f"<r{i}>", "record_type": "revisit", "payload": rng.bytes(50_000)} for i in range(6)]
    data = b"".join(warc.to_member(warc.to_bytes(r)) for r in big)
    assert gzip.decompress(data) == b"".join(map(warc.to_bytes, big))  # ordinary gzip to others
    file = _Counting(data)
    archive, ids = warc._Gzip(file), []
    while (block := archive.headers()) is not None:
        head = warc.parse_headers(block)
        ids.append(head["record_id"])
        archive.skip(head["length"])
    assert ids == [r["record_id"] for r in big] and file.read_bytes < len(data) / 20


@pytest.mark.parametrize("members", ["own", "foreign", "three in one", "plain"])
@pytest.mark.parametrize("skipping", [0, 1, 2])
def test_archives_of_all_kinds(members, skipping):
    import gzip

    records = _records(31)
    texts = [warc.to_bytes(r).replace(b"Content-Length: ", b"content-length:") for r in records]
    if members == "own":
        data = b"".join(map(warc.to_member, texts))
    elif members == "plain":
        data = b"".join(texts)
    else:
        size = 3 if members == "three in one" else 1
        data = b"".join(gzip.compress(b"".join(texts[i : i + size])) for i in range(0, 31, size))
    read = warc._Plain if members == "plain" else warc._Gzip

    def all_of(data):
        archive, out = read(_Counting(data)), []
        while (block := archive.headers()) is not None:
            head = warc.parse_headers(block)
            wanted = skipping == 0 or len(out) % (skipping + 1)
            out.append((head["record_id"], archive.payload(head["length"]) if wanted else archive.skip(head["length"])))
        return out

    out = all_of(data)
    assert [i for i, _ in out] == [r["record_id"] for r in records]
    assert all(p is None or p == r["payload"] for (_, p), r in zip(out, records, strict=True))
    for cut in range(len(data) - 400, len(data), 7):
        with pytest.raises(ValueError):
            all_of(data[:cut])


def test_failed_write_leaves_no_archive(spark, tmp_path):
    from pyspark.sql import functions as F

    warc.register(spark)
    bad = spark.range(10).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("record_id"), *(F.lit(None).cast("string").alias(c) for c in ("record_type", "target_uri", "refers_to", "payload_digest")), F.assert_true(F.col("id") < 9).cast("long").alias("payload_bytes"), F.lit(None).cast("binary").alias("payload"))
    with pytest.raises(Exception):
        bad.write.format("warc").mode("append").save(str(tmp_path / "w"))
    assert not list((tmp_path / "w").glob("*"))


def test_pages_with_odd_rows(spark):
    long = "x" * 3_000_000
    pages = spark.createDataFrame([(3, "u", "a" * 100), (1, None, "a" * 100), (2, "v", "a" * 99), (4, "w", "a" * 99), (None, "n", "a" * 100), (5, "e", None), (6, "é", ""), (7, "l", long), (8, "l", long), (1, None, "a" * 100)], PAGES)
    out = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(with_clashes(pages)).collect())
    assert out == sorted([("3", "revisit", 1, 100), ("1", "response", None, 100), ("1", "response", None, 100), ("2", "response", None, 99), ("4", "response", None, 99), ("None", "revisit", 1, 100), ("5", "response", None, 0), ("6", "response", None, 0), ("7", "response", None, 3_000_000), ("8", "revisit", 7, 3_000_000)])
    assert warc.round_trip(empty(spark, PAGES)).count() == 0


# Exact top-k


def plain_top(rows, k):
    """The answers as a sorted list: a query for every row with a query id, against all other rows."""
    use = [(i, [math.floor(64 * np.float32(x).item()) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(use):
        if i is not None and i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for n, (j, v) in enumerate(use) if n != at)
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def top(df, k):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, k).collect()), key=str)


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_against_brute_force(spark, clustered):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * (20 if clustered else 0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.2 + centre[i % 6]]) for i in range(1500)]
    rows += [(2000 + i, rows[20][1]) for i in range(700)]  # one vector a third of the rows share, and ties
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(5)
    assert top(df, 7) == plain_top(rows, 7)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (60, [None, 1.0]), (80, [float("inf"), 1.0]), (1, [1.0]), (2, [0.5, -0.01, 9.0]), (3, []), (None, [2.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (100, [0.0, 0.0]), (120, [3e4, -3e4])]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    out = knn.top_k(with_clashes(df), 4)
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()), key=str) == plain_top(rows, 4)
    assert content(knn.top_k(df.repartition(6), 4)) == content(out)
    assert knn.top_k(empty(spark, VECTORS)).count() == 0
    assert knn.top_k(spark.createDataFrame([(0, [1.0], 0)], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        knn.top_k(spark.createDataFrame([(0, [1e30], 0)], VECTORS))


@pytest.mark.parametrize("cells", [1, 3])
def test_top_k_where_a_query_id_repeats(spark, cells):
    rows = [(20, [100.0, float(i % cells)]) for i in range(30)] + [(i, [99.0, 0.0]) for i in range(1, 6)]
    rows += [(1001 + i, [-100.0, i / 64]) for i in range(500) if (1001 + i) % 20]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(3)
    got = top(df, 20)
    assert len(got) == 30 * 20 and got == plain_top(rows, 20)


def test_top_k_of_rows_that_repeat_a_query(spark):
    """Two vectors of one id are two queries, candidates of each other; equal rows too."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 1.0])]
    assert top(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), 3) == plain_top(rows, 3)


def test_a_small_query_set_has_many_parts(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 16, "BLOCKS_IN_PART": 2, "GROUP_QUERIES": 8, "LARGE_GROUP": 2}.items():
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in [*range(1, 20), 20, *range(21, 40), 40, *range(1001, 2501)] if i % 20 or i in (20, 40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(3)
    assert top(df, 5) == plain_top(rows, 5)
    plan = knn.top_k(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(0, (parts" in plan
    many = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(0, 4000, 5)]
    assert top(spark.createDataFrame([(*r, 0) for r in many], VECTORS), 5) == plain_top(many, 5)


def test_parts_grow_with_the_blocks():
    pivots = np.zeros((1, 2))
    cells = knn.Cells(pivots, np.array([512 * 400, 512 * 9, 1, 0]), np.ones(4), np.array([1]), np.full((1, 6), np.inf))
    assert cells.blocks().tolist() == [400, 9, 1, 1]


def test_far_cells_are_not_needed():
    pivots = np.array([[100.0, 0], [-100.0, 0]])
    counts, radius = np.array([50, 0, 0, 1, 50, 0, 0, 1]), np.array([5.0, 0, 0, 400, 5, 0, 0, 6])
    cells = knn.Cells(pivots, counts, radius, np.array([1, 1]), np.tile(np.linspace(0, 5, 6), (2, 1)))
    assert cells.needed(np.array([[90.0, 3.0]]), 5).tolist() == [0, 3]  # not the other cell; of its own, the far ring alone besides
