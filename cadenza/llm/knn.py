"""Exact top-k by inner product, as a Voronoi join of queries and data.

Components become floor(64 * x). Pivots from a bounded sample split the space into Voronoi cells, and each cell into
RINGS rings by distance from its pivot. Summaries (a ring's size and radius, a cell's least distances from its pivot)
give bounds: by Cauchy and Schwarz the score of q with anything in a ring of pivot p is within |q| * radius of q.p. The
least distances give every query a score that k data are sure to reach; a query group needs only the rings whose
radius lets them reach it, so that a few far vectors do not make a whole cell needed. Rings travel as packed blocks,
to the groups that need them and no others, and each group solves its queries block by block with a running top k.
Where vectors are spread so evenly that hardly a ring can be ruled out, that is the stated query set against all
rows, in blocks, and LARGE_GROUP groups are joined into one, so that fewer copies of the blocks travel.

A group has at most GROUP_QUERIES queries (or LARGE_GROUP times as many) and a block at most about BLOCK_ROWS vectors,
whatever the cells' sizes, so a vector that a third of the rows share makes more blocks, not larger ones. A group's
blocks are dealt to as many parts as their number asks for, about UNITS over all groups, so a small query set spreads
over many tasks too; the parts' results merge in two steps. Nothing of the data's size reaches the driver: it gets the
sample and a summary row per ring.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; every row with a query id is a query, and every row but itself its candidate, also those that
repeat its id or all of it; a null id is a candidate that stands after all others at a tie; an empty table gives an
empty result; extra columns are ignored. Scores that might leave 63 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SAMPLE = 16_384
MAX_PIVOTS = 256
#: A cell's rings end at these shares of its sample.
RING_SHARES = (0.5, 0.75, 0.95)
RINGS = len(RING_SHARES) + 1
GROUP_QUERIES = 2048
LARGE_GROUP = 8
BLOCK_ROWS = 512
BLOCKS_IN_PART = 16
UNITS = 4096
NO_ID = np.iinfo(np.int64).max


def _rows(column: pa.Array, width: int, scale: float | None = 64.0) -> np.ndarray:
    """A list column as a matrix, padded with zeros to `width`."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out, flat = np.zeros((len(lengths), width)), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width) < lengths[:, None]] = flat
    return np.floor(scale * out) if scale else out


@dataclass
class Cells:
    """Pivots and, per cell and per ring (cell * RINGS + number), the summary of its data."""

    pivots: np.ndarray
    counts: np.ndarray  # by ring
    radius: np.ndarray  # by ring
    queries: np.ndarray  # by cell
    nearest: np.ndarray  # by cell: the k + 1 least distances from the pivot; infinite where there are fewer

    def needed(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which rings may hold one of the k best of any of the queries q."""
        along, norm = q @ self.pivots.T, np.linalg.norm(q, axis=1)
        low = (along[:, :, None] - norm[:, None, None] * self.nearest[None]).reshape(len(q), -1)
        low[~np.isfinite(low)] = -np.inf
        at = min(k, low.shape[1] - 1)  # one more than k: the query itself may be among them
        sure = -np.partition(-low, at, axis=1)[:, at]
        high = np.repeat(along, RINGS, axis=1) + norm[:, None] * self.radius
        slack = 1e-9 * (1 + np.abs(high))
        return np.flatnonzero(((high + slack >= sure[:, None]).any(axis=0)) & (self.counts > 0))

    def blocks(self) -> np.ndarray:
        """The number of blocks of each ring."""
        return np.maximum(1, -(-self.counts // BLOCK_ROWS))


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first pivots of a sample; fewer if it holds fewer different vectors."""
    chosen, distance = [sample[0]], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and distance.max() > 0:
        chosen.append(sample[distance.argmax()])
        distance = np.minimum(distance, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell and its distance from that cell's pivot."""
    cell = ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1) if len(x) else np.zeros(0, int)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def _edges(sample: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Where the rings of each cell end, but the last, which has no end."""
    cell, distance = _nearest_pivot(sample, pivots)
    return np.array([np.quantile(distance[cell == c], RING_SHARES) if (cell == c).any() else np.zeros(RINGS - 1) for c in range(len(pivots))])


def _assign(vectors: DataFrame, pivots: np.ndarray, edges: np.ndarray, dtype: str) -> DataFrame:
    """vec_id, is_query, ring, distance, vector (packed) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("embedding"), pivots.shape[1])
            cell, distance = _nearest_pivot(x, pivots)
            ring = cell * RINGS + (distance[:, None] > edges[cell]).sum(axis=1)
            packed = pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("is_query"), pa.array(ring.astype(np.int32)), pa.array(distance), packed], ["vec_id", "is_query", "ring", "distance", "vector"])

    return vectors.mapInArrow(run, "vec_id long, is_query boolean, ring int, distance double, vector binary")


def _summaries(assigned: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    def cut(distances: np.ndarray) -> np.ndarray:
        return np.sort(distances)[: k + 1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ring, distance, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ring", "distance", "is_query"))
            for c in np.unique(ring).tolist():
                own = ring == c
                n, nq, radius, near = held.get(c, (0, 0, 0.0, np.zeros(0)))
                held[c] = [n + int(own.sum()), nq + int(query[own].sum()), max(radius, float(distance[own].max())), cut(np.concatenate([near, distance[own]]))]
        columns = list(zip(*held.values(), strict=True)) if held else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array([list(x) for x in columns[3]], pa.list_(pa.float64()))], ["ring", "n", "nq", "radius", "near"])

    def merge(table: pa.Table) -> pa.Table:
        near = cut(table.column("near").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        n, nq = (int(table.column(c).to_numpy().sum()) for c in ("n", "nq"))
        return pa.table({"ring": table.column("ring").slice(0, 1), "n": [n], "nq": [nq], "radius": [float(table.column("radius").to_numpy().max())], "near": pa.array([near.tolist()], pa.list_(pa.float64()))})

    schema = "ring int, n long, nq long, radius double, near array<double>"
    rows = assigned.select("ring", "distance", "is_query").mapInArrow(partial, schema).groupBy("ring").applyInArrow(merge, schema).collect()
    m = len(pivots)
    out = Cells(pivots, np.zeros(m * RINGS, np.int64), np.zeros(m * RINGS), np.zeros(m, np.int64), np.full((m, k + 1), np.inf))
    for r in rows:
        c = r["ring"] // RINGS
        out.counts[r["ring"]], out.radius[r["ring"]] = r["n"], r["radius"]
        out.queries[c] += r["nq"]
        out.nearest[c] = cut(np.concatenate([out.nearest[c], r["near"]]))
    return out


def _groups(cells: Cells) -> list[tuple[int, int]]:
    """Per cell (first group, number of groups): near cells share a group up to GROUP_QUERIES, a larger cell is split."""
    left, out, group, room = set(range(len(cells.pivots))), [(0, 1)] * len(cells.pivots), -1, 0
    at = 0
    while left:
        left.discard(at)
        n = int(cells.queries[at])
        if n > room:
            parts = math.ceil(n / GROUP_QUERIES)
            out[at], group = (group + 1, parts), group + parts
            room = GROUP_QUERIES - n if parts == 1 else 0
        else:
            out[at], room = (max(group, 0), 1), room - n
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((cells.pivots[rest] - cells.pivots[at]) ** 2).sum(axis=1).argmin()])
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype("<i8")


def _best(row: np.ndarray, id_: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row by (score descending, id)."""
    order = np.lexsort((id_, -score, row))
    row, id_, score = row[order], id_[order], score[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
    keep = rank < k
    return row[keep], id_[keep], score[keep]


class _Running:
    """The top k of a query group over the blocks seen so far; queries are told apart by their place in the group."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
        self.floor_id = np.full(len(ids), NO_ID, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        s = (self.q @ x.T).astype(np.int64)
        row, at = np.nonzero((s > self.floor[:, None]) | ((s == self.floor[:, None]) & (ids <= self.floor_id[:, None])))
        self.row, self.id, self.score = _best(np.concatenate([self.row, row]), np.concatenate([self.id, ids[at]]), np.concatenate([self.score, s[row, at]]), self.k)
        last = np.flatnonzero(np.diff(self.row, append=-1))
        full = last[np.bincount(self.row, minlength=len(self.ids))[self.row[last]] == self.k]
        self.floor[self.row[full]], self.floor_id[self.row[full]] = self.score[full], self.id[full]

    def own(self) -> np.ndarray:
        """Each query's score with itself."""
        return (self.q * self.q).sum(axis=1).astype(np.int64)


def _without_own(row: np.ndarray, found: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the k + 1 best are not the query's own row: the first with its id and its score with itself. Copies of it look alike."""
    itself = np.flatnonzero((found == ids[row]) & (score == own[row]))
    first = itself[np.diff(row[itself], prepend=-1) != 0]
    keep = np.ones(len(row), bool)
    keep[first] = False
    return keep


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every vec_id divisible by `every`."""
    e = F.col("embedding")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(e.isNotNull() & usable).withColumn("is_query", is_query)
    width, largest, n = clean.agg(F.max(F.size(e)), F.max(F.array_max(F.transform(e, lambda x: F.abs(x) * 64))), F.count("*")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        width, largest = 1, 0.0  # no vector, or empty ones only: all scores are zero
    bound = width * (largest + 1) ** 2
    if bound >= 2.0**63:
        raise ValueError("components too large: scores might leave 63 bits")
    dtype = "<i2" if largest < 32_000 else "<f8" if bound < 2.0**53 else "<i8"
    exact = np.float64 if bound < 2.0**53 else np.int64  # either adds the integers without rounding

    sample = clean.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    points = _rows(sample.column("embedding").combine_chunks(), width)
    pivots = _pivots(points, max(1, min(MAX_PIVOTS, math.isqrt(len(points)), n // (RINGS * BLOCK_ROWS))))  # a ring fills a block at least
    assigned = stage(_assign(clean, pivots, _edges(points, pivots), dtype))
    cells = _summaries(assigned, pivots, k)
    groups, blocks_of = _groups(cells), cells.blocks()
    n_groups = max(g + n for g, n in groups)

    def matrix(blobs: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(blobs.to_pylist()), dtype).reshape(-1, width)

    def packed_group(table: pa.Table, need: np.ndarray, ids: bytes, body: bytes) -> pa.Table:
        return pa.table({"grp": table.column("grp").slice(0, 1), "need": pa.array([need.tolist()], pa.list_(pa.int32())), "blocks": [int(blocks_of[need].sum())], "ids": pa.array([ids], pa.binary()), "body": pa.array([body], pa.binary())})

    def pack_queries(table: pa.Table) -> pa.Table:
        q = matrix(table.column("vector"))
        return packed_group(table, cells.needed(q.astype(np.float64), k), _ids(table.column("vec_id")).tobytes(), q.tobytes())

    def join_groups(table: pa.Table) -> pa.Table:
        need = np.unique(table.column("need").combine_chunks().flatten().to_numpy())
        return packed_group(table, need, *(b"".join(table.column(c).to_pylist()) for c in ("ids", "body")))

    def pack_block(table: pa.Table) -> pa.Table:
        return pa.table({"ring": table.column("ring").slice(0, 1), "slot": table.column("slot").slice(0, 1), "ids": pa.array([_ids(table.column("vec_id")).tobytes()], pa.binary()), "body": pa.array([matrix(table.column("vector")).tobytes()], pa.binary())})

    def lookup(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in values)), at + 1)

    cell = F.expr(f"ring div {RINGS}").cast("int")
    dealt = F.xxhash64("vec_id", "vector").bitwiseAND(2**40 - 1)
    ask = assigned.where("is_query").select("vec_id", "vector", (lookup([g for g, _ in groups], cell) + F.xxhash64("vec_id").bitwiseAND(2**40 - 1) % lookup([n for _, n in groups], cell)).cast("int").alias("grp"))
    group_schema = "grp int, need array<int>, blocks long, ids binary, body binary"
    queries = stage(ask.groupBy("grp").applyInArrow(pack_queries, group_schema))
    if n_groups > 1 and 2 * (queries.agg(F.sum("blocks")).first()[0] or 0) > n_groups * int(blocks_of.sum()):
        queries = stage(queries.withColumn("grp", F.expr(f"grp div {LARGE_GROUP}").cast("int")).groupBy("grp").applyInArrow(join_groups, group_schema))
        n_groups = -(-n_groups // LARGE_GROUP)
    parts = F.least(F.ceil(F.col("blocks") / BLOCKS_IN_PART), F.lit(-(-UNITS // n_groups))).cast("int")
    queries = queries.withColumn("parts", F.greatest(parts, F.lit(1)))

    blocks = assigned.withColumn("slot", (dealt % lookup(blocks_of, F.col("ring"))).cast("int")).groupBy("ring", "slot").applyInArrow(pack_block, "ring int, slot int, ids binary, body binary")
    wanted = queries.select("grp", "parts", F.explode("need").alias("ring"))
    sent = blocks.join(wanted, "ring").select("grp", F.pmod(F.hash("ring", "slot"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "ids", "body")
    asked = queries.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "ids", "body")

    def result(grp: int, part: int, ids: bytes, own: bytes, row: np.ndarray, found: np.ndarray, score: np.ndarray) -> dict:
        out = {"grp": pa.array([grp], pa.int32()), "part": pa.array([part], pa.int32())}
        return out | {c: pa.array([v], pa.binary()) for c, v in (("ids", ids), ("own", own), ("row", row.tobytes()), ("found", found.tobytes()), ("score", score.tobytes()))}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and part, the queries before the blocks."""
        state, key = None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(result(*key, state.ids.tobytes(), state.own().tobytes(), state.row, state.id, state.score))

        for batch in batches:
            for i in range(batch.num_rows):
                unit, kind = (batch.column("grp")[i].as_py(), batch.column("part")[i].as_py()), batch.column("kind")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
                body = np.frombuffer(batch.column("body")[i].as_buffer(), dtype).reshape(-1, width).astype(exact)
                if kind == 0:
                    if state is not None:
                        yield flush()
                    state, key = _Running(ids, body, k + 1), unit
                else:
                    state.add(ids, body)
        if state is not None:
            yield flush()

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, found, score = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("row", "found", "score"))
        return _best(row, found, score, k + 1)

    def merge_some(table: pa.Table) -> pa.Table:
        return pa.table(result(table.column("grp")[0].as_py(), table.column("part")[0].as_py(), *(table.column(c)[0].as_py() for c in ("ids", "own")), *merged(table)))

    def merge(table: pa.Table) -> pa.Table:
        ids, own = (np.frombuffer(table.column(c)[0].as_buffer(), "<i8") for c in ("ids", "own"))
        row, found, score = merged(table)
        keep = _without_own(row, found, score, ids, own)
        row, found, score = row[keep], found[keep], score[keep]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(1, len(row) + 1) - np.repeat(starts, np.diff(starts, append=len(row)))
        keep = rank <= k
        return pa.table({"query_id": ids[row[keep]], "rank": rank[keep].astype(np.int32), "vec_id": pa.array(found[keep], mask=found[keep] == NO_ID), "score": score[keep]})

    ordered = sent.unionByName(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    part_schema = "grp int, part int, ids binary, own binary, row binary, found binary, score binary"
    solved = ordered.mapInArrow(solve, part_schema)
    some = solved.withColumn("part", F.expr(f"part div {math.isqrt(UNITS)}").cast("int"))
    return some.groupBy("grp", "part").applyInArrow(merge_some, part_schema).groupBy("grp").applyInArrow(merge, schema)
