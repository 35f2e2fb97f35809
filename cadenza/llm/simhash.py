"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Two fingerprints within
DISTANCE bits of each other have a word between them that is within DISTANCE / 2 of both. So every distinct
fingerprint emits all 2,081 words of its ball of that radius, the words are shuffled, and fingerprints that meet at
a word are linked. All that meet there are within DISTANCE of each other, so linking them to the least one loses no
connection; each link is verified all the same. At most 2,081 fingerprints can meet at a word: no key is hot.

A word with its mask's number takes ten bytes, and a fingerprint's ball some times the room of its text. So the
words are dealt in PASSES passes by parities of their bits (a mask's parities tell which fingerprints need it in
which pass: nothing is made in vain), and a pass's shuffle files are removed when its links are written. In a pass,
words travel sorted by bucket in packed arrays of about ROW_WORDS words or more, so that none is large; the number of
buckets grows with the fingerprints, so that a task holds about BUCKET_WORDS words at any size. Components then join the links.

Defined cases: a null or empty text has fingerprint zero, which links like any other; fewer words than a shingle
make one shingle; repeated rows share a fingerprint; a component whose ids are all null has a null component_id;
an empty table gives an empty result; wordless documents
are one component whatever the similarity; `keep_one` keeps extra columns, `near_duplicates` ignores them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minima
from .common import append_columns, configured, packed, possible, stage
from .components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
PASSES = 4
BUCKET_WORDS = 1 << 19
ROW_WORDS = 256
#: Fingerprints whose words are made at once: more where there are more buckets, so that rows keep their length.
CHUNKS = (256, 2048)

#: Multiplying by an odd number spreads words over buckets, and is undone by its inverse.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UNSPREAD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PARITIES = (np.uint64(0x5555555555555555), np.uint64(0x3333333333333333))


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most `radius` bits set."""
    bits = [np.uint64(1 << i) for i in range(64)]
    layers = [np.zeros(1, np.uint64)]
    for _ in range(radius):
        layers.append(np.unique(np.concatenate([layers[-1] ^ b for b in bits] + [layers[-1][:0]])))
    return np.unique(np.concatenate(layers))


def _pass_of(words: np.ndarray) -> np.ndarray:
    low, high = (np.bitwise_count(words & p) & np.uint8(1) for p in _PARITIES)
    return low | high << np.uint8(1)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's `size`-word shingles, A-Z lower-cased."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(size, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, size: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """`docs` and a long column _fp, of `size`-word shingles; `sketched`: and the fields of `minima`, in the same pass."""

    def compute(texts: list[bytes]) -> dict[str, pa.Array]:
        prints = {"_fp": pa.array([fingerprint(t, size) for t in texts], pa.int64())}
        return prints | minima.sketches(texts) if sketched else prints

    return append_columns(docs, "text", [("_fp", T.LongType()), *(minima.FIELDS if sketched else [])], compute)


def _chunk(bucket_bits: int, ball_size: int) -> int:
    return min(max(CHUNKS[0], PASSES * (ROW_WORDS << bucket_bits) // ball_size), max(1, CHUNKS[1] * 2081 // ball_size))


def _emit(step: int, bucket_bits: int, distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a pass: rows (bucket, spread words, mask numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(distance // 2)
        numbers, chunk = np.arange(len(masks), dtype="<u2"), _chunk(bucket_bits, len(masks))
        mask_pass = _pass_of(masks)
        for batch in batches:
            all_ = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_), chunk):
                some = all_[at : at + chunk]
                groups = _pass_of(some)
                keys, which = [], []
                for g in range(PASSES):
                    own, theirs = some[groups == g], mask_pass == g ^ step
                    keys.append(((own[:, None] ^ masks[theirs]) * _SPREAD).ravel())
                    which.append(np.tile(numbers[theirs], len(own)))
                key, number = np.concatenate(keys), np.concatenate(which)
                bucket = (key >> np.uint64(64 - bucket_bits)).astype(np.uint16 if bucket_bits <= 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                key, number, bucket = key[order], number[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ 1)) if len(bucket) else np.zeros(0, np.int64)
                ends = [*cuts[1:].tolist(), len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts].astype(np.int32)),
                        pa.array([key[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary()),
                        pa.array([number[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary()),
                    ],
                    ["bucket", "words", "masks"],
                )

    return run


def _collide(distance: int) -> Callable[[pa.Table], pa.Table]:
    """Links (a, b) among the fingerprints that meet at a word of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        masks = ball(distance // 2)
        key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")])
        number = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table.column("masks")])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, number = key[met], number[order[met]]
        if not len(key):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        prints = key * _UNSPREAD ^ masks[number]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        least = np.minimum.reduceat(prints, np.flatnonzero(first))[np.cumsum(first) - 1]
        linked = (prints != least) & (np.bitwise_count(prints ^ least) <= distance)
        pairs = np.unique(np.stack([prints[linked], least[linked]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(pairs[:, 1].view(np.int64))})

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column fp, staged) within `distance` bits: 0, 2, 4 or 6.

    At an odd distance those that meet at a word could be a bit too far apart; from 8 on a ball has some 700,000 words.
    """
    if distance not in (0, 2, 4, 6):
        raise ValueError("distance must be 0, 2, 4 or 6")
    spark = prints.sparkSession
    words = prints.count() * len(ball(distance // 2)) // PASSES
    bits = 5
    while words >> bits > BUCKET_WORDS:
        bits += 1
    found = []
    for step in range(PASSES):
        with configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            met = prints.select("fp").mapInArrow(_emit(step, bits, distance), "bucket int, words binary, masks binary")
            found.append(stage(met.groupBy("bucket").applyInArrow(_collide(distance), "a long, b long").distinct()))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _rooted(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, least (its least doc_id) and root (its component's fingerprint) of every distinct fingerprint of `rows`."""
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = components(links(prints, distance))
    return stage(prints.join(star, prints["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    rows = stage(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.col("_fp").alias("fp")))
    rooted = _rooted(rows)
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_print = stage(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _content(docs: DataFrame) -> dict[str, Column]:
    """Two hashes of a packed row's columns and of which are null; columns with maps or variants cannot be hashed and are left out."""
    fields = [f for f in docs.schema["_doc"].dataType.fields if not re.search("map<|variant", f.dataType.simpleString())]
    values = [F.col(f"_doc.`{f.name}`") for f in fields]
    parts = [*values, *(v.isNull() for v in values)]
    return {"_h1": F.xxhash64(*parts), "_h2": F.xxhash64(F.lit(SEED), *parts)}


def _regrouped(members: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """`members` with the roots of components that `minima` joins: those whose first documents have the similarity."""
    firsts = stage(members.groupBy("root").agg(F.min("key").alias("first")).select(F.col("root").alias("node"), "first.*"))

    def same(other: DataFrame) -> Column:
        return firsts["doc_id"].eqNullSafe(other["doc_id"]) & (firsts["_h1"] == other["_h1"]) & (firsts["_h2"] == other["_h2"])

    sketched = stage(rows.join(firsts, same(rows)).select("node", "_minima", "_bands").dropDuplicates(["node"]))
    links = minima.candidates(sketched, similarity)
    if links.isEmpty():
        return members
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    firsts = stage(firsts.join(ends, "node"))
    texts = possible(texts, firsts.select("_h1"), "_h1").where("_possible")
    read = stage(texts.join(firsts, same(texts)).select("node", "text").dropDuplicates(["node"]))
    star = components(stage(minima.verified(links, read, similarity)))
    return stage(members.join(star, members["root"] == star["node"], "left").select(F.coalesce(star["root"], members["root"]).alias("root"), "n", "key"))


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """One document of each component (fingerprints of `size` words, `distance` bits), the first by (doc_id, nulls last; content), its columns as they were.

    With a `similarity`, components whose first documents have at least that Jaccard similarity of shingles are one
    component too, as `minima` finds them. Rows are told apart by id and content, so what goes in one component touches
    no other. Of rows that repeat the kept one, id and all, a single one stays.
    """
    whole = packed(docs)
    whole = whole.withColumns(_content(whole)).withColumn("_key", F.col("_doc.doc_id"))
    texts = whole.select(F.col("_key").alias("doc_id"), F.col("_doc.text").alias("text"), "_h1", "_h2")
    sketched = similarity is not None
    rows = stage(with_fingerprint(texts, size, sketched).select("doc_id", "_h1", "_h2", F.col("_fp").alias("fp"), *(f for f, _ in minima.FIELDS if sketched)))
    keys = stage(rows.groupBy("doc_id", "_h1", "_h2", "fp").agg(F.count("*").alias("n")))
    members = stage(keys.join(_rooted(rows, distance), "fp").select("root", "n", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_h1", "_h2", "fp").alias("key")))
    if similarity is not None:
        members = _regrouped(members, rows, texts, similarity)
    first = stage(members.groupBy("root").agg(F.min("key").alias("first")))
    marked = members.join(first, "root").withColumn("once", F.col("key").eqNullSafe(F.col("first"))).where("not once or n > 1")
    marked = stage(marked.select("once", F.col("key.doc_id").alias("_id"), F.col("key._h1").alias("_a"), F.col("key._h2").alias("_b")))
    gone, once = marked.where("not once").drop("once"), marked.where("once").drop("once")

    def those(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), how)

    whole = possible(whole, marked.select("_a"), "_h1")  # what is surely kept stays where it is
    sure, kept = whole.where("not _possible"), those(whole.where("_possible"), gone, "left_anti")
    if not once.isEmpty():
        single = those(kept, once, "left_semi").dropDuplicates(["_h1", "_h2"])
        kept = those(kept, once, "left_anti").unionByName(single)
    return sure.unionByName(kept).select("_doc.*")
