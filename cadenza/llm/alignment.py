"""Alignment of two tokenizers over the same bytes, by a dictionary of groups.

Both tokenizers cover the bytes of a space and the text. Where tokens of both end, the text falls into groups, each a
run of A ids and a run of B ids over the same bytes; a word's group comes again wherever the word does. Inside a group
no two tokens end together but the last, so its overlapping pairs, the links, are one fewer than its tokens, and follow
from the ids alone. So:

* Documents are encoded in blocks of about BLOCK_BYTES of text. A block interns its distinct groups: a row each, with
  its frequency and the number of documents; a document keeps numbers of its block's groups.
* The blocks' rows add up by group key. Every distinct group's links are expanded once, and multiplied by its
  frequency they give the count of each id pair, and those the highest of each B id.
* Each distinct group's links meet the pair counts and add up to the group's own values, which go back to the blocks by
  group key; a block's documents then look up their groups' values.

What is shuffled is a row per distinct group of a block, not per token; words that all texts share are keys of a join,
which Spark splits, or of sums, which combine first. A block holds a bounded text or one document.

Defined cases: a text that is null or empty, or whose tokens do not spell a space and the text, has no tokens, zeros
and an empty hash; strings of special tokens are plain text; repeated rows and null ids are documents each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, texts
from .packing import _PLAIN, _fast

BLOCK_BYTES = 4 << 20
_SPACE = "▁"


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def _exact(path: str):
    """The tokenizers library's encoder; special tokens' strings are plain text to it."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: itself if printable, else one of those from U+0100 on, in turn."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@cache
def a_bytes(path: str) -> list[bytes]:
    """The bytes of each A id."""
    alphabet, model = byte_alphabet(), _exact(path)
    spelt = (model.id_to_token(i) for i in range(model.get_vocab_size()))
    return [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in spelt]


@cache
def b_bytes(path: str) -> list[bytes]:
    """The bytes of each B id."""
    model = _pieces(path)
    spelt = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace(_SPACE, " ").encode() for i, t in enumerate(spelt)]


@cache
def _lengths(kind: str, path: str) -> np.ndarray:
    return np.array([len(t) for t in (a_bytes if kind == "a" else b_bytes)(path)], np.int64)


def encode(text: str, models: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """A ids of a space and the text, and B ids of the text; both empty where they do not spell the same bytes."""
    none, spaced = np.zeros(0, np.int64), " " + text
    if not text:
        return none, none
    fast = None if _PLAIN.search(text) else _fast(models[0])
    a = fast.encode_ordinary(spaced) if fast else _exact(models[0]).encode(spaced, add_special_tokens=False).ids
    b = _pieces(models[1]).encode(text)
    raw = spaced.encode("utf-8", "surrogatepass")
    if b"".join(map(a_bytes(models[0]).__getitem__, a)) != raw or b"".join(map(b_bytes(models[1]).__getitem__, b)) != raw:
        return none, none
    return np.array(a, np.int64), np.array(b, np.int64)


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the tokens, given by their lengths, lie before the end of each group, on both sides."""
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    at = np.searchsorted(b_ends, a_ends)
    both = b_ends[np.minimum(at, max(len(b) - 1, 0))] == a_ends if len(b) else np.zeros(len(a), bool)
    return np.flatnonzero(both) + 1, at[both] + 1


def group_links(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in a, in b) of the tokens of a group that overlap."""
    a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    ends = np.union1d(a_ends, b_ends)  # a link ends at each
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Block:
    """The documents of a block, and its distinct groups in order of first occurrence."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, ...] | int, int] = {}
        self.names: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, a: np.ndarray, b: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, str]:
        """(numbers of its groups, times of each, groups, hash) of a document."""
        if not len(a):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), 0, ""
        a_to, b_to = cuts(lengths[0][a], lengths[1][b])
        a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
        single = (a_to - a_from == 1) & (b_to - b_from == 1)
        keys = np.where(single, a[a_from] << 16 | b[b_from], -1).tolist()
        known, numbers, a_ids, b_ids = self.known, [], None, None
        for at, key in enumerate(keys):
            if key < 0:
                if a_ids is None:
                    a_ids, b_ids, a_from, a_to, b_from, b_to = (x.tolist() for x in (a, b, a_from, a_to, b_from, b_to))
                key = (*a_ids[a_from[at] : a_to[at]], -1, *b_ids[b_from[at] : b_to[at]])
            number = known.get(key)
            if number is None:
                number = known[key] = len(known)
                self.names.append(f"{key >> 16}|{key & 65_535}" if isinstance(key, int) else ",".join(map(str, key)).replace(",-1,", "|"))
            numbers.append(number)
        digest = hashlib.sha256(";".join(map(self.names.__getitem__, numbers)).encode()).hexdigest()
        which, times = np.unique(np.array(numbers, np.int32), return_counts=True)
        return which, times.astype(np.int32), len(numbers), digest


_DOCUMENT = "doc_id, n_a, n_b, n_groups, groups_sha256, numbers, times"
_GROUP = "number, name, frequency, documents"


def blocks(docs: DataFrame, models: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of both kinds, by block: documents (number is null) and the block's distinct groups (name `a1,a2|b1`)."""
    models = models or default_models()
    docs = docs.select("doc_id", "text")
    added = "n_a long, n_b long, n_groups long, groups_sha256 string, numbers binary, times binary, number int, name string, frequency long, documents long"
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(added).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def made(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in arrow], arrow.names)

    def of_groups(block: Block, number: int) -> Iterator[pa.RecordBatch]:
        total, present = np.zeros((2, len(block.known)), np.int64)
        for which, times in block.times:
            total[which] += times
            present[which] += 1
        for at in range(0, len(block.known), 10_000):
            some = slice(at, at + 10_000)
            names = pa.array(block.names[some])
            yield made({"block": pa.array(np.full(len(names), number)), "number": pa.array(np.arange(at, at + len(names))), "name": names, "frequency": pa.array(total[some]), "documents": pa.array(present[some])}, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths = _lengths("a", models[0]), _lengths("b", models[1])
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                of: list[int] = []
                for text in texts(part.column(1)):
                    if block.bytes and block.bytes + len(text) > block_bytes:
                        yield from of_groups(block, number)
                        number, block = number + 1, Block()
                    a, b = encode(text.decode("utf-8", "replace"), models)
                    which, times, n, digest = block.add(a, b, lengths)
                    block.times.append((which, times))
                    block.bytes += len(text)
                    rows.append((len(a), len(b), n, digest, which.tobytes(), times.tobytes()))
                    of.append(number)
                n_a, n_b, n_groups, digests, which_, times_ = zip(*rows, strict=True)
                yield made({"block": pa.array(of), "doc_id": part.column(0), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "groups_sha256": pa.array(digests), "numbers": pa.array(which_, pa.binary()), "times": pa.array(times_, pa.binary())}, len(rows))
        yield from of_groups(block, number)

    return docs.mapInArrow(run, schema)


def groups(found: DataFrame) -> DataFrame:
    """name, frequency and documents (with it) of every distinct group, from `blocks`."""
    some = found.where("number is not null")
    return some.groupBy("name").agg(F.sum("frequency").alias("frequency"), F.sum("documents").alias("documents"))


def links(dictionary: DataFrame, models: tuple[str, str] | None = None) -> DataFrame:
    """name, frequency, documents, a, b, n: how often (n) the ids a and b are linked in each distinct group."""
    models = models or default_models()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths("a", models[0]), _lengths("b", models[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, pairs, times = [], [], []
                for i, name in enumerate(part.column(0).to_pylist()):
                    a, b = (np.array(ids.split(","), np.int64) for ids in name.split("|"))
                    if len(a) == 1 or len(b) == 1:
                        pair = a << 16 | b
                    else:
                        x, y = group_links(a, b, *lengths)
                        pair = a[x] << 16 | b[y]
                    pair, n = np.unique(pair, return_counts=True)
                    row.append(np.full(len(pair), i))
                    pairs.append(pair)
                    times.append(n)
                at_, pair = np.concatenate(row), np.concatenate(pairs)
                columns = [part.column(c).take(pa.array(at_)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((pair >> 16).astype(np.int32)), pa.array((pair & 65_535).astype(np.int32)), pa.array(np.concatenate(times))], ["name", "frequency", "documents", "a", "b", "n"])

    return dictionary.select("name", "frequency", "documents").mapInArrow(run, "name string, frequency long, documents long, a int, b int, n long")


def pair_counts(linked: DataFrame, weight: str = "frequency") -> DataFrame:
    """a, b, count and best of every linked pair: how many links hold it (weight: frequency), or how many (document, group) have it (documents); best: the highest of its B id."""
    n = F.col("n") * F.col(weight) if weight == "frequency" else F.col(weight)
    counts = stage(linked.groupBy("a", "b").agg(F.sum(n).alias("count")))
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("_most"))  # a row per B id
    return counts.join(F.broadcast(most), F.col("b") == F.col("_b")).select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, models: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = stage(blocks(docs, models, block_bytes))
    linked = stage(links(groups(found), models))
    pairs = pair_counts(linked).withColumnsRenamed({"a": "_a", "b": "_b"})
    met = linked.join(pairs, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    values = met.groupBy("name").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    values = values.withColumnRenamed("name", "_name")
    own = found.where("number is not null").select(F.col("block").alias("of"), "number", "name")
    back = own.join(values, F.col("name") == F.col("_name")).select("of", "number", "n_best", "count_sum")
    rows = found.where("number is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "numbers", "times")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def looked_up(documents: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("number").to_numpy())
        best, count = (table.column(c).to_numpy()[order] for c in ("n_best", "count_sum"))
        sums = []
        for which, times in zip(documents.column("numbers").to_pylist(), documents.column("times").to_pylist(), strict=True):
            which, times = np.frombuffer(which, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
            sums.append((int(times @ best[which]), int(times @ count[which])))
        n_best, count_sum = zip(*sums, strict=True) if sums else ((), ())
        n_a, n_b, n_groups = (documents.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups"))
        return pa.table([documents.column("doc_id").combine_chunks(), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), documents.column("groups_sha256").combine_chunks()], names=schema.names)

    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(looked_up, schema)
