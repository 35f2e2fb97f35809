import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, empty, odd, odd_rows, with_clashes

from cadenza.llm import alignment, catalog

A, B = alignment.default_models()


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def plain(texts):
    """The query's rows, token by token: every pair of overlapping occurrences, every group by its ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    a_table, b_table = alignment.a_bytes(A), alignment.b_bytes(B)
    docs, count = [], Counter()
    for text in texts:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if b"".join(a_table[i] for i in a) != f" {text}".encode() or b"".join(b_table[i] for i in b) != f" {text}".encode():
            a, b = [], []
        a, b = spans(a, a_table), spans(b, b_table)
        links, low = [], 0
        for start, end, i in a:
            while low < len(b) and b[low][1] <= start:
                low += 1
            at = low
            while at < len(b) and b[at][0] < end:
                links.append((i, b[at][2]))
                at += 1
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        names, x, y = [], 0, 0
        for end in ends:
            parts = [[], []]
            while x < len(a) and a[x][1] <= end:
                parts[0].append(str(a[x][2]))
                x += 1
            while y < len(b) and b[y][1] <= end:
                parts[1].append(str(b[y][2]))
                y += 1
            names.append("|".join(map(",".join, parts)))
        docs.append((len(a), len(b), len(names), links, hashlib.sha256(";".join(names).encode()).hexdigest() if a else ""))
        count.update(links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(na, nb, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), h) for na, nb, g, links, h in docs]


def rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_of_sf_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((str(d.doc_id), *r) for d, r in zip(docs, plain([d.text for d in docs]), strict=True))
    assert rows(catalog.QUERIES["op13_alignment"](spark, sf_dir)) == expected


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 20])
def test_odd_documents_in_any_blocks(spark, block_bytes):
    more = [(900, "a▁b", "en", "a", 1), (901, "<s> </s> <unk> <0x41> <|endoftext|>", "en", "a", 1), (902, "\x00 \r\n\t 　 ﬁ é ＡＢＣ", "en", "a", 1), (903, "   lead  and trail   ", "en", "a", 1), (904, "中文分词测试🎉🎉", "zh", "a", 1)]
    table = [r for r in odd_rows() if len(r[1] or "") < 50_000] + more
    docs = with_clashes(spark.createDataFrame(table, DOCS)).selectExpr("*", "1 as block", "2 as number", "3 as name", "4 as count")
    expected = sorted((str(t[0]), *r) for t, r in zip(table, plain([t[1] for t in table]), strict=True))
    assert rows(alignment.align(docs, block_bytes=block_bytes)) == expected
    assert (("900", 0, 0, 0, 0, 0, 0, "") in expected) and any(r[0] == "901" and r[1] for r in expected)


def test_empty_table_and_a_very_long_text(spark):
    assert alignment.align(empty(spark)).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0)], DOCS)).count() == 2
    assert alignment.align(odd(spark)).where("n_a >= 30000").count() == 1


def test_group_tables(spark):
    docs = spark.createDataFrame([(1, "the cat the cat", "en", "a", 1), (2, "the dog", "en", "a", 1)], DOCS)
    found = alignment.blocks(docs, block_bytes=4)  # a block each
    by = {r.name: (r.frequency, r.documents) for r in alignment.groups(found).collect()}
    assert by[next(n for n, v in by.items() if v[1] == 2)] == (3, 2) and sum(f for f, _ in by.values()) == sum(r.n_groups for r in found.where("number is null").collect())
    linked = alignment.links(alignment.groups(found))
    assert {(r.a, r.b): r["count"] for r in alignment.pair_counts(linked, "documents").collect()}.keys() == {(r.a, r.b) for r in linked.collect()}


def test_links_of_a_group():
    a, b = np.array([0, 1, 2]), np.array([0, 1])
    lengths = np.array([2, 3, 1]), np.array([4, 2])
    x, y = alignment.group_links(a, b, *lengths)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 1)]
