"""A second way to near-duplicates: bands over the minima of shingle hashes, verified by exact Jaccard similarity.

SimHash at 4 of 64 bits finds copies with few changes; texts whose SHINGLE-word shingles have a Jaccard similarity of
0.8 differ in some ten bits. So a text also gets MINIMA minima of its shingle hashes, kept as a byte each, and BANDS
keys of ROWS minima: two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, .992 at 0.8.

Only keys that two or more texts share go on. A key's texts are dealt to blocks of about BLOCK, and each two blocks
meet in one piece of work, so no group is in one task, however many share a key, and none is cut. There, a maximum
spanning forest over the estimated similarities is found: a link for each text at most, never all pairs, yet whatever
two texts a pair links are linked by a path of links no less similar by the estimate. Estimates down to three standard
errors below the similarity pass, and every link is then verified on the whole texts. What can be lost: pairs that
share no key, and paths on which an estimate was off.

Defined cases: null and wordless texts take no part; fewer words than a shingle make one shingle; repeated shingles
count once; an empty table gives no links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

SHINGLE = 5
SEED = 42
MINIMA = 256
BANDS = 12
ROWS = 5
BLOCK = 512
_CHUNK = 1024

FIELDS = [("_minima", T.BinaryType()), ("_bands", T.ArrayType(T.LongType()))]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's `size`-word shingles, A-Z lower-cased, sorted."""
    import xxhash

    words = text.lower().split()
    width = min(size, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.unique(np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """An exclusive-or mask and an odd factor for each minimum."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, (MINIMA, 1), np.uint64), rng.integers(0, 1 << 64, (MINIMA, 1), np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hash that each order puts first; `hashes` is not empty."""
    masks, factors = orders
    least, first = np.full(MINIMA, np.iinfo(np.uint64).max), np.zeros(MINIMA, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        some = hashes[at : at + _CHUNK]
        ranks = (some ^ masks) * factors
        best = ranks.argmin(axis=1)
        found = np.take_along_axis(ranks, best[:, None], axis=1)[:, 0]
        better = found <= least
        least[better], first[better] = found[better], some[best[better]]
    return first


def sketches(texts: list[bytes]) -> dict[str, pa.Array]:
    """FIELDS of texts: a byte of each minimum, and the bands' keys; both null without words."""
    import xxhash

    orders, rows, keys = _orders(), [], []
    for text in texts:
        hashes = shingles(text)
        if not len(hashes):
            rows.append(None)
            keys.append(None)
            continue
        first = minima(hashes, orders)
        rows.append(first.astype(np.uint8).tobytes())
        keys.append([xxhash.xxh64_intdigest(first[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)])
    return {"_minima": pa.array(rows, pa.binary()), "_bands": pa.array(keys, pa.list_(pa.int64()))}


def forest(nodes: np.ndarray, bytes_: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of a maximum spanning forest over texts of which `least` or more minima agree."""
    n, at, links = len(nodes), 0, []
    best, link, left = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n - 1):
        left[at] = False
        agree = np.count_nonzero(bytes_ == bytes_[at], axis=1)
        better = left & (agree > best)
        best[better], link[better] = agree[better], at
        at = int(np.where(left, best, -2).argmax())
        if best[at] >= least:
            links.append((int(nodes[link[at]]), int(nodes[at])))
    return links


def _meet(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The forests of pieces of work that arrive sorted by key, x, y; one piece is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            own = np.stack([table.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist()]
            held = table.slice(cuts[-1])
            links = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in piece(table.slice(a, b - a))]
            yield rows(links)
        if held is not None:
            yield rows(piece(held))

    def piece(table: pa.Table) -> list[tuple[int, int]]:
        joined = b"".join(table.column("minima").to_pylist())
        return forest(table.column("node").to_numpy(), np.frombuffer(joined, np.uint8).reshape(-1, MINIMA), least)

    def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = ([f(x) for x in links] for f in (min, max))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def candidates(sketched: DataFrame, similarity: float) -> DataFrame:
    """a, b (staged, a < b): links to verify among `sketched`, a row per node (long, distinct) with its FIELDS."""
    keys = stage(sketched.where("_bands is not null").select("node", F.explode("_bands").alias("key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = keys.join(shared, "key").select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("x"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("x")))
    pieces = dealt.withColumn("y", F.explode(others)).select("key", "node", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    work = pieces.join(sketched.select("node", F.col("_minima").alias("minima")), "node").select("key", "x", "y", "node", "minima")
    least = math.ceil(MINIMA * (similarity - 3 * math.sqrt(similarity * (1 - similarity) / MINIMA)))
    met = work.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet(least), "a long, b long")
    return stage(met.distinct())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def verified(links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of `links`, those whose texts (columns node, text) have the similarity; a text moves once per link of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(c).cast(pa.binary()) for c in ("left", "right")), strict=True)
            keep = [jaccard(*(shingles(t.as_py() or b"") for t in pair)) >= similarity for pair in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "left"), ("b", "right")))
    return links.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")
