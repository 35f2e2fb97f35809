import collections
import zlib

import numpy as np
import pytest
from helpers import content, empty, odd, odd_rows, with_clashes

from cadenza.llm import catalog, mixing, packing


def test_mix_equals_sql(spark, sf_dir):
    from oracle import same

    same(catalog.op3_mixing(spark, sf_dir), catalog.ORACLES["op3_mixing"], sf_dir)


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, None: 90}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, _size long")
    out = {r.source: r.target for r in mixing.targets(df).collect()}
    assert out["a"] == 30 and out["c"] == 0 and out["b"] <= 3000 and abs(sum(out.values()) - 1100) < 1e-6
    assert out[None] == 270 and abs(out["b"] - 800) < 1e-6  # both others at three times their size


def test_shares_of_odd_documents(spark):
    docs = odd(spark)
    out = mixing.shares(docs).collect()
    assert len(out) == docs.count() and all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in out)
    assert sum(r.taken for r in out) <= sum(r.size for r in out)
    assert content(mixing.shares(with_clashes(docs).repartition(7))) == content(mixing.shares(docs))
    mixed = mixing.mixed(with_clashes(docs))
    assert mixed.columns == with_clashes(docs).columns
    counts = collections.Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None)
    taken = collections.Counter()
    for r in out:
        if r.doc_id is not None and r.size:
            taken[r.doc_id] += r.taken // r.size
    assert counts == +taken
    assert mixing.shares(empty(spark)).count() == 0 == mixing.mixed(empty(spark)).count()


def test_sources_come_near_their_targets(spark, sf_dir):
    out = catalog.op3_mixing(spark, sf_dir.replace("0.001", "0.01")).toPandas()
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "source").toPandas()
    by = out.merge(docs, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= 2 * by.largest + 1).all()


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 65, 200).tolist(), reverse=True)
    bins, rooms = packing.BestFit(64), []
    for n in lengths:
        sequence, offset = bins.place(n)
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if not fits:
            rooms.append(64)
            assert sequence == len(rooms) - 1 and offset == 0
        else:
            assert rooms[sequence] == min(fits)[0]
        assert offset == 64 - rooms[sequence]
        rooms[sequence] -= n
    assert len(rooms) <= 11 / 9 * sum(lengths) / 64 + 1


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_those_of_tokenizers(tokenizer):
    odd_texts = [r[1] or "" for r in odd_rows()] + ["it's we'LL 'S  x", "a b  c　", "İı ẞ", "é ñ", "<|endoftext|>", "a <|endo", "١٢٣ ⅷ ²", "﻿bom", "a\x1cb\x1fc\x85d", "tab\t\tx \n y", "“q” — … €5", "ǅ ȸ ɏ ɐ"]
    for text in odd_texts:
        assert packing.encode(text, packing.tokenizer_path()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_round_trip(spark, tokenizer):
    rows = odd_rows()
    out = packing.pack_documents(odd(spark), keep_ids=True).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = collections.defaultdict(dict)
    for r in out:
        pieces[r.doc_id].setdefault(r.piece, bytes(r.ids))
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for d, t in text.items():
        ids = np.frombuffer(b"".join(v for _, v in sorted(pieces[d].items())), "<u4").tolist()
        assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert len(bins) <= sum(r.length for r in out) / 1024 * 1.05 + 1
    assert content(packing.pack_documents(with_clashes(odd(spark)))) == content(packing.pack_documents(odd(spark)))
    assert packing.pack_documents(empty(spark)).count() == 0


def test_mix_of_a_row_that_a_third_repeats(spark):
    """100,000 rows without an id and 100,000 of one id, beside others: each place is one row of the queue."""
    from pyspark.sql import functions as F

    hot = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    others = spark.range(1000, 4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("other").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = mixing._sized(hot.unionByName(others)).select("source", "_size", "_place")
    places = rows.groupBy("source", "_place").agg(F.sum("_size").alias("_size"))
    assert places.where("source = 'hot'").count() == 2
    out = mixing.shares(hot.unionByName(others)).groupBy("doc_id", "size", "taken", "source_size").count().collect()
    assert sum(r["count"] for r in out) == 203_000 and {r["count"] for r in out if r.source_size == 600_000} == {100_000}
    assert sum(r.taken * r["count"] for r in out) <= sum(r["size"] * r["count"] for r in out)


def test_mix_is_cut_inside_a_range(spark, sf_dir, monkeypatch):
    from cadenza.llm.common import read

    docs = read(spark, sf_dir, "documents")
    expected = content(mixing.shares(docs))
    for rows in (1, 50):
        monkeypatch.setattr(mixing, "SORT_ROWS", rows)
        assert content(mixing.shares(docs.repartition(5))) == expected


def test_packing_of_a_row_that_repeats(spark):
    """200,000 equal pieces are dealt over all groups, and packed as tightly as others."""
    from pyspark.sql import functions as F

    pieces = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(100).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    groups = 200_000 // packing.GROUP_ROWS
    out = packing.pack(pieces, groups)
    per = out.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins")).collect()
    assert sum(r.n for r in per) == 200_000 and max(r.n for r in per) < 2 * packing.GROUP_ROWS
    assert sum(r.bins for r in per) <= 200_000 / 10 + groups
    assert out.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_ids_of_all_documents_are_those_of_tokenizers(tokenizer, sf_dir):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(sf_dir.replace("0.001", "0.01") + "/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for text, ids in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.encode(text, packing.tokenizer_path()).tolist() == ids.ids


def test_running_totals_over_many_ranges(spark, monkeypatch):
    """Blocks of ranges, for a source with many rows, against plain sums."""
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", 2)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = mixing._sized(spark.range(400).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', null) as source", "repeat('w ', int(id % 7 + 1)) as text")).selectExpr("source", "_size", "_place", "1 as source_size", "1 as target")
    got = mixing._running(rows).collect()
    assert len(got) == 400
    for source in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.source == source), key=lambda r: tuple(r._place)):
            total += r._size
            assert r._cum == total


def test_groups_hold_pieces_not_documents(spark, monkeypatch):
    """Long documents make more groups, not larger ones."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 64)
    docs = spark.range(40).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 20000) as text")
    out = packing.pack_documents(docs).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in out)
    assert len(out) > 1500 and max(groups.values()) <= 2 * 64
    assert all(r.offset + r.length <= 1024 for r in out)
    assert len({r.sequence_id for r in out}) <= sum(r.length for r in out) / 1024 + len(groups)
