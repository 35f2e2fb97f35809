"""Best-fit decreasing packing of token sequences.

Documents become token ids and an end id; one longer than the capacity is cut into full pieces, the first of which
may be shorter. Equal pieces (in every column) are counted before they are shuffled, and travel as one row with the
number of copies, at most COPIES of them. Those rows are dealt by a hash into groups of about GROUP_ROWS pieces (the
pieces are counted, not the documents, so long texts make more groups, not larger ones), and a piece that a third of all rows repeat is spread over as many groups, and each group is packed by itself: longest
first, each into the open sequence with the least room that still holds it. A segment tree over the remaining
capacities (its leaves count the open sequences with so much room) finds that in log2(capacity) steps. A group leaves
at most about one sequence unfilled, so groups cost well under a part in a thousand, and no task ever holds more than
a group. The outcome does not depend on how the rows were partitioned.

Defined cases: a null text is an empty one, which is its end id alone; equal lengths go in order of id and piece;
repeated rows are packed each; null ids are packed as any other; an empty table gives an empty result; extra columns
are ignored by `tokenise` and kept by `pack` (but for maps, which cannot be compared).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stage, texts

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 2048
COPIES = 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts of these characters alone are encoded by the faster of two libraries with the same vocabulary; their
#: Unicode tables agree there. Any other text, and one that spells a special token, goes to `tokenizers` itself.
_PLAIN = re.compile("[^\x00-ɏ‐-›€]|<\\|")


@cache
def _exact(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str):
    """The faster encoder, None if there is no .tiktoken file beside `path`."""
    import base64
    import os

    ranks = re.sub(r"json$", "tiktoken", path)
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """The ids that tokenizers gives for `text` without special tokens added. A worker loads only the encoders that it needs."""
    fast = None if _PLAIN.search(text) else _fast(path)
    if fast is None:
        return np.array(_exact(path).encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = length % capacity or capacity
    bounds = [0, *range(first, length + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece of every document."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # ids take some times the room of the text
                part = batch.slice(at, 512)
                rows, pieces, starts, lengths, blobs = [], [], [], [], []
                for row, text in enumerate(texts(part.column(1))):
                    ids = encode(text.decode("utf-8", "replace"), path).tobytes() + np.uint32(end_id).astype("<u4").tobytes()
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        blobs.append(ids[4 * start : 4 * (start + length)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.mapInArrow(run, schema)


class BestFit:
    """Open sequences by room left; a segment tree with the number of them under each node."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves = capacity, 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _add(self, room: int, change: int) -> None:
        node, counts = self.leaves + room, self.open
        while node:
            counts[node] += change
            node >>= 1

    def _tightest(self, length: int) -> int:
        """The least room of at least `length` that an open sequence has, or -1."""
        node, counts = self.leaves + length, self.open
        while not counts[node]:  # up and to the right, to the first subtree with something open
            while node & 1:
                node >>= 1
                if not node:
                    return -1
            node += 1
            if node & (node - 1) == 0:
                return -1
        while node < self.leaves:
            node = 2 * node + (not counts[2 * node])
        return node - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for the next piece."""
        room = self._tightest(length)
        if room < 0:
            room, sequence = self.capacity, self.made
            self.made += 1
        else:
            sequence = self.rooms[room].pop()
            self._add(room, -1)
        left = room - length
        if left:
            self.rooms[left].append(sequence)
            self._add(left, 1)
        return sequence, self.capacity - room


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length, any others) with sequence_id and offset; lengths from 1 to `capacity`."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns
    id_at, piece_at, length_at = (names.index(c) for c in ("doc_id", "piece", "length"))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.take(np.repeat(np.arange(table.num_rows), table.column("_copies").to_numpy())).drop_columns(["_group", "_copies"])
        ids, numbers, lengths = (table.column(i).to_pylist() for i in (id_at, piece_at, length_at))
        order = sorted(range(table.num_rows), key=lambda i: (-lengths[i], ids[i] is None, ids[i] or 0, numbers[i]))
        bins, sequences, offsets = BestFit(capacity), np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for i in order:
            sequences[i], offsets[i] = bins.place(lengths[i])
        return table.append_column("sequence_id", pa.array(sequences + (group << 32))).append_column("offset", pa.array(offsets))

    counted = pieces.groupBy(*names).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))))
    copies = F.least(F.col("_n") - COPIES * F.col("_block"), F.lit(COPIES))
    by = [c for c in ("doc_id", "piece", "length", "ids_crc32") if c in names]
    dealt = blocks.select(*names, copies.alias("_copies"), F.pmod(F.xxhash64(*by, "_block"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document."""
    pieces = tokenise(docs).withColumn("ids_crc32", F.crc32("ids"))
    pieces = stage(pieces if keep_ids else pieces.drop("ids"))
    return pack(pieces, max(1, pieces.count() // GROUP_ROWS))
