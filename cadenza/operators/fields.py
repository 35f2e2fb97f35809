"""Flow fields and grids whole: a row holds a grid as a list, and kernels take a batch of grids at once.

What follows a displacement through frames gathers the edges of its hops in one shuffle; what depends on its last
result is a fold whose state is a grid, one scene at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .grids import linear

Grids = np.ndarray  # (n, height, width)


def grids(column: pa.Array, height: int, width: int) -> Grids:
    """A list column without nulls as grids."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * height * width:
        raise ValueError(f"a grid does not have {height} x {width} cells")
    return flat.reshape(-1, height, width)


def lists(values: Grids, kind: pa.DataType | None = None) -> pa.Array:
    n = len(values)
    flat = np.ascontiguousarray(values).reshape(-1)
    size = len(flat) // n if n else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(flat, kind))


def places(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[:height, :width].astype(np.float64)
    return x, y


def sample(values: Grids, x: Grids, y: Grids, edge: str = "nearest") -> Grids:
    """Values between cells, bilinear. Beyond the edge stand the nearest cells' values, or zeros (edge `zero`)."""
    n, height, width = values.shape
    if edge == "nearest":
        x, y = np.clip(x, 0, width - 1), np.clip(y, 0, height - 1)
    x0, y0 = np.floor(x), np.floor(y)
    out, row = np.zeros(x.shape), np.arange(n)[:, None, None]
    for oy in (0, 1):
        for ox in (0, 1):
            cx, cy = x0 + ox, y0 + oy
            weight = np.abs(1 - ox - (x - x0)) * np.abs(1 - oy - (y - y0))
            inside = (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
            at = values[row, np.clip(cy, 0, height - 1).astype(int), np.clip(cx, 0, width - 1).astype(int)]
            out += np.where(inside & (weight > 0), at * weight, 0)
    return out


def sample_nearest(values: Grids, x: Grids, y: Grids, outside: Any = 0) -> Grids:
    """The value of the nearest cell; `outside` beyond the edge."""
    n, height, width = values.shape
    cx, cy = np.rint(x).astype(int), np.rint(y).astype(int)
    inside = (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
    return np.where(inside, values[np.arange(n)[:, None, None], np.clip(cy, 0, height - 1), np.clip(cx, 0, width - 1)], outside)


def summed(of: Callable[..., Column]) -> Column:
    """The measure `of` of each cell (its value, and if wanted its number) of `grids`, the lists that a frame comes with; cells of more than one list add up, nulls aside."""
    both = lambda a, b: F.coalesce(a + b, a, b)
    return F.aggregate(F.slice("grids", 2, F.size("grids")), F.transform(F.col("grids")[0], of), lambda s, g: F.zip_with(s, F.transform(g, of), both))


def resampled(frames: DataFrame, height: int, width: int, places: list[tuple[int, int, float, float]], measures: dict[str, Callable]) -> DataFrame:
    """frame, y, x and each measure at fixed places (y, x, px, py) of every frame: between the cells about (px, py) by the measure's shares, the border repeated.

    A measure is a column of `frames`, a list of height * width cells in order of rows. Nulls do not count; a place about
    which a measure has no cells (a short list) gives no row. A row needs nothing but its own grid, so nothing is shuffled.
    """

    def taps(shares: Callable) -> tuple[np.ndarray, np.ndarray]:
        cells, weights = [], []
        for _, _, px, py in places:
            px, py = max(0.0, min(width - 1.0, px)), max(0.0, min(height - 1.0, py))
            about = [(math.floor(py) + oy, math.floor(px) + ox, wx * wy) for oy, wy in shares(py - math.floor(py)) for ox, wx in shares(px - math.floor(px))]
            cells.append([max(0, min(y, height - 1)) * width + max(0, min(x, width - 1)) for y, x, _ in about])
            weights.append([w for _, _, w in about])
        return np.array(cells), np.array(weights)

    def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values (0 for null), which are not null, and which are there."""
        size, n = height * width, len(column)
        sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten()
        row, at = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = at < size
        values, known = np.zeros((n, size)), np.zeros((n, size), dtype=bool)
        values[row[inside], at[inside]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)[inside]
        known[row[inside], at[inside]] = flat.is_valid().to_numpy(zero_copy_only=False)[inside]
        return values, known, np.arange(size) < sizes[:, None]

    plans = {name: taps(shares) for name, shares in measures.items()}
    y, x = (np.array([place[i] for place in places], dtype=np.int32) for i in (0, 1))
    out = T.StructType([frames.schema["frame"], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(name, T.DoubleType()) for name in measures)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keep, columns = batch.num_rows, np.ones(batch.num_rows * len(places), dtype=bool), []
            for name, (cells, weights) in plans.items():
                values, known, there = dense(batch.column(name))
                total, any_, hit = np.zeros((n, len(places))), np.zeros((n, len(places)), dtype=bool), np.zeros((n, len(places)), dtype=bool)
                for k in range(cells.shape[1]):
                    total += np.where(known[:, cells[:, k]], values[:, cells[:, k]] * weights[:, k], 0.0)
                    any_ |= known[:, cells[:, k]]
                    hit |= there[:, cells[:, k]]
                columns.append(pa.array(total.reshape(-1), mask=~any_.reshape(-1)))
                keep &= hit.reshape(-1)
            frame = batch.column("frame").take(pa.array(np.repeat(np.arange(n), len(places))))
            made = pa.RecordBatch.from_arrays([frame, pa.array(np.tile(y, n)), pa.array(np.tile(x, n)), *columns], names=out.names)
            yield made.filter(pa.array(keep))

    return frames.select("frame", *measures).mapInArrow(run, out)


def centres(height: int, width: int, new_height: int, new_width: int) -> list[tuple[int, int, float, float]]:
    """y, x of the cells of a grid of another size, and where their centres lie in the old one (px, py)."""
    place = lambda c, old, new: (c + 0.5) * (old / new) - 0.5
    return [(y, x, place(x, width, new_width), place(y, height, new_height)) for y in range(new_height) for x in range(new_width)]


def resized_flow(frames: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """frame, y, x, v of flow along x, the lists v of `frames`, on a grid of another size: sampled at the cells' centres, and scaled as the width is."""
    return resampled(frames, height, width, centres(height, width, new_height, new_width), {"v": linear}).withColumn("v", F.col("v") * (new_width / width))


def chained(edges: DataFrame, hops: int, height: int, width: int, back: bool = False) -> DataFrame:
    """scene, frame, dx, dy, confidence: where each frame's cells are `hops` frames on (or back), and the least confidence met.

    edges: scene, frame, dx, dy, confidence, a row per frame; null lists where a frame has no edge in this direction.
    Each edge is sampled where the displacement so far leads; beyond the grid it is zero. A missing edge ends the
    chain there with confidence 0. An edge goes to the `hops` frames that pass it, in one shuffle.
    """
    sent = edges.withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(hops - 1)))).withColumn("start", F.col("frame") + F.col("hop") * (1 if back else -1))
    grouped = sent.groupBy("scene", "start").agg(F.collect_list(F.struct("hop", "dx", "dy", "confidence")).alias("edges"))
    rows = grouped.where(F.exists("edges", lambda e: e["hop"] == 0)).select("scene", F.col("start").alias("frame"), "edges")  # of frames that there are
    schema = T.StructType([rows.schema["scene"], rows.schema["frame"], *T.StructType.fromDDL("dx array<double>, dy array<double>, confidence array<double>").fields])
    x, y = places(height, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(2), batch.num_rows
            edge, owner = column.flatten(), np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
            hop = edge.field("hop").to_numpy()
            there = edge.field("dx").is_valid().to_numpy(zero_copy_only=False)
            total, confidence, alive = np.zeros((2, n, height, width)), np.ones((n, height, width)), np.ones(n, bool)
            for k in range(hops):
                some = np.flatnonzero((hop == k) & there & alive[owner])
                dx, dy, own = (grids(edge.field(c).take(pa.array(some)), height, width).astype(float) for c in ("dx", "dy", "confidence"))
                at = owner[some]
                px, py = x + total[0, at], y + total[1, at]
                confidence[at] = np.minimum(confidence[at], sample(own, px, py, "zero"))
                total[0, at] += sample(dx, px, py, "zero")
                total[1, at] += sample(dy, px, py, "zero")
                gone = np.ones(n, bool)
                gone[at] = False
                confidence[gone], alive[gone] = 0, False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(lists, (*total, confidence))], schema.names)

    return rows.mapInArrow(run, schema)


def per_pair(pairs: DataFrame, columns: list[str], of: Callable[..., tuple[Grids, ...]], out: str, height: int, width: int) -> DataFrame:
    """`pairs` without its list `columns`, and the grids `out` that `of` makes from those, batch by batch."""
    keys = [c for c in pairs.columns if c not in columns]
    schema = T.StructType([*(pairs.schema[c] for c in keys), *T.StructType.fromDDL(out).fields])
    rows = pairs.select(*keys, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = of(*(grids(batch.column(len(keys) + i), height, width).astype(float) for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *map(lists, made)], schema.names)

    return rows.mapInArrow(run, schema)


FLOWS = ["first", "second", "dx", "dy", "back_dx", "back_dy"]


def reliability(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """Confidence of the flow from `first` to `second` (0 to 255): falls with what the flow back leaves of the way, and with the difference of the images; 0 where the flow leaves the grid."""
    x, y = places(height, width)

    def of(first: Grids, second: Grids, dx: Grids, dy: Grids, back_dx: Grids, back_dy: Grids) -> tuple[Grids]:
        px, py = x + dx, y + dy
        left = np.hypot(dx + sample(back_dx, px, py, "zero"), dy + sample(back_dy, px, py, "zero"))
        cycle = np.exp(-left / np.maximum(0.65 + 0.035 * np.hypot(dx, dy), 1e-3))
        photo = np.exp(-np.abs(first - sample(second, px, py, "zero")) / 28)
        return (np.where((px >= 0) & (px <= width - 1) & (py >= 0) & (py <= height - 1), cycle * photo, 0),)

    return per_pair(pairs, FLOWS, of, "confidence array<double>", height, width)


def validated(pairs: DataFrame, height: int, width: int, trip: float = 0.75, photo: float = 12, depth: float = 0.06) -> DataFrame:
    """Which cells a flow links (valid) and the flow in shares of the grid: the round trip, the image and the depth (first_depth, second_depth) at its end must all agree, and the end must lie inside."""
    x, y = places(height, width)

    def of(first: Grids, second: Grids, dx: Grids, dy: Grids, back_dx: Grids, back_dy: Grids, own: Grids, other: Grids) -> tuple[Grids, ...]:
        px, py = x + dx, y + dy
        good = np.hypot(dx + sample(back_dx, px, py), dy + sample(back_dy, px, py)) < trip
        good &= (np.abs(first - sample(second, px, py)) < photo) & (np.abs(own - sample(other, px, py)) < depth)
        good &= (px >= 0) & (px < width - 1) & (py >= 0) & (py < height - 1)
        return good, dx / (width - 1), dy / (height - 1)

    return per_pair(pairs, [*FLOWS, "first_depth", "second_depth"], of, "valid array<boolean>, u array<double>, v array<double>", height, width)


def grid_fold(df: DataFrame, keys: list[str], order: str, step: Callable[[Any, dict], tuple[Any, dict]], fields: str, columns: list[str]) -> DataFrame:
    """The rows with the grids that a rule makes from its last result: `step` takes the state (None at a key's start) and a row, with lists as arrays.

    Rows are dealt by key and sorted within partitions; of a key only the state is held. A key is one task's: use scenes.
    """
    added = T.StructType.fromDDL(fields)
    schema, types = T.StructType([*(df.schema[c] for c in columns), *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = [batch.column(i) for i in range(batch.num_columns)]
            made = []
            for i in range(batch.num_rows):
                row = {}
                for name, column in zip(batch.schema.names, rows, strict=True):
                    cell = column[i]
                    row[name] = cell.values.to_numpy(zero_copy_only=False) if pa.types.is_list(cell.type) and cell.is_valid else cell.as_py()
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, None
                state, new = step(state, row)
                made.append(new)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *(pa.array([m[f.name] for m in made], f.type) for f in types)], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def resized(values: Grids, height: int, width: int) -> Grids:
    """Bilinear, corners on corners."""
    n, h, w = values.shape
    y, x = np.meshgrid(np.linspace(0, h - 1, height), np.linspace(0, w - 1, width), indexing="ij")
    return sample(values, np.broadcast_to(x, (n, height, width)), np.broadcast_to(y, (n, height, width)))


def compensated(amount: float, shape: tuple[int, int], motion_shape: tuple[int, int], frame: tuple[int, int]) -> Callable[[np.ndarray | None, dict], tuple[np.ndarray, dict]]:
    """A step: `depth` blended with the last result, drawn along the row's motion (dx, dy in pixels of `frame`, as confidence times flow; confidence 0 to 255; valid).

    The blend is confidence times `amount`; a row without motion (null) blends all cells alike. Motion of another shape
    is brought to the depth's.
    """
    x, y = places(*shape)
    height, width = shape
    frame_height, frame_width = frame

    def step(last: np.ndarray | None, row: dict) -> tuple[np.ndarray, dict]:
        depth = np.asarray(row["depth"], float).reshape(shape)
        if last is None or amount <= 0:
            return depth, {"out": depth.ravel()}
        if row["dx"] is None:
            out = depth * (1 - amount) + last * amount
            return out, {"out": out.ravel()}
        confidence = np.asarray(row["confidence"], float) / 255 * np.asarray(row["valid"], float)
        fields = np.stack([np.asarray(row["dx"], float) / np.maximum(confidence, 1 / 255), np.asarray(row["dy"], float) / np.maximum(confidence, 1 / 255), confidence]).reshape(3, *motion_shape)
        dx, dy, trust = fields if motion_shape == shape else resized(fields, height, width)
        px, py = x + dx * (width - 1) / max(1, frame_width - 1), y + dy * (height - 1) / max(1, frame_height - 1)
        blend = np.clip(trust * amount, 0, amount)
        out = depth * (1 - blend) + sample(last[None], px[None], py[None])[0] * blend
        return out, {"out": out.ravel()}

    return step


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    p = np.pad(mask, radius)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1, 2 * radius + 1)).any(axis=(2, 3))


def reused(trust: float, strength: float, photo: float, shape: tuple[int, int], refresh: int, ring: int = 4) -> Callable[[tuple | None, dict], tuple[tuple, dict]]:
    """A step that repairs holes from its last result: row has `seed` (0 to 255), `hole`, dx, dy, confidence (0 to 1), `at` (frames since the scene's start).

    The last result, drawn along the motion, is blended into the holes where it was a hole itself then, the motion is
    trusted, and the trusted cells about the holes look alike. Every `refresh` frames all holes count as left to fill,
    though the blend stays, as a seed. What is left (`residual`) keeps the seed here; a generator would fill it.
    """
    x, y = places(*shape)

    def step(last: tuple[np.ndarray, np.ndarray] | None, row: dict) -> tuple[tuple[np.ndarray, np.ndarray], dict]:
        seed, hole = np.asarray(row["seed"], float).reshape(shape), np.asarray(row["hole"], bool).reshape(shape)
        if last is None or row["dx"] is None:
            return (seed, hole), {"out": seed.ravel(), "residual": hole.ravel(), "reused": 0, "photometric": 1.0}
        dx, dy, confidence = (np.asarray(row[c], float).reshape(shape) for c in ("dx", "dy", "confidence"))
        px, py = (x + dx)[None], (y + dy)[None]
        warped, known = sample(last[0][None], px, py)[0], sample_nearest(last[1][None], px, py, False)[0]
        about = grown(hole, ring) & ~hole & (confidence >= trust)
        difference = float(np.abs(warped - seed)[about].mean() / 255) if about.any() else 1.0
        again = hole & known & (confidence >= trust) & (difference <= photo)
        out = np.where(again, seed * (1 - strength) + warped * strength, seed)
        if row["at"] % refresh == 0:
            again = np.zeros_like(again)
        return (out, hole), {"out": out.ravel(), "residual": (hole & ~again).ravel(), "reused": int(again.sum()), "photometric": difference}

    return step


# Lengths of a step along and across, of the 3 x 3 distance.
STRAIGHT, DIAGONAL = 0.955, 1.3693


def inward_distance(mask: np.ndarray) -> np.ndarray:
    """Of each set cell of grids (n, h, w), the way to the nearest cell that is not: the least sum of straight and diagonal steps. Infinite without such a cell; beyond the grid there is none."""
    n, height, width = mask.shape
    d = np.full((n, height + 2, width + 2), np.inf)
    d[:, 1:-1, 1:-1] = np.where(mask, np.inf, 0)
    for backwards in (False, True):  # two passes, each from the neighbours it has seen
        s = -1 if backwards else 1
        for y in range(1, height + 1)[::s]:
            for x in range(1, width + 1)[::s]:
                near = np.minimum(np.minimum(d[:, y, x - s], d[:, y - s, x]) + STRAIGHT, np.minimum(d[:, y - s, x - s], d[:, y - s, x + s]) + DIAGONAL)
                d[:, y, x] = np.minimum(d[:, y, x], near)
    return d[:, 1:-1, 1:-1]


def inward_feather(mask: np.ndarray, radius: float) -> np.ndarray:
    """0 outside a mask, rising smoothly to 1 at `radius` inside it."""
    if radius <= 0:
        return mask.astype(float)
    t = np.clip(inward_distance(mask) / max(0.5, radius), 0, 1)
    return np.where(mask, t * t * (3 - 2 * t), 0)


def gaussian_feather(mask: np.ndarray, radius: float) -> np.ndarray:
    """A mask blurred by a Gaussian of that deviation, on both sides of its edge; the grid is mirrored about its outer cells."""
    if radius <= 0:
        return mask.astype(float)
    reach = round(radius * 4) or 1
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * radius * radius))
    weights /= weights.sum()
    out = mask.astype(float)
    for axis in (1, 2):
        size = out.shape[axis]
        at = np.arange(-reach, size + reach)
        if size > 1:
            at = np.abs(at) % (2 * size - 2)
            at = np.where(at >= size, 2 * size - 2 - at, at)
        else:
            at = at * 0
        padded = out.take(at, axis=axis)
        out = sum(w * padded.take(range(i, i + size), axis=axis) for i, w in enumerate(weights))
    return np.clip(out, 0, 1)


def pyramid_fill(df: DataFrame, value: str, name: str, levels: int) -> DataFrame:
    """Unknown (null) cells of (frame, y, x) filled from the smallest block, of side 2, 4, 8, ... cells, that knows any: its mean. One shuffle by frame."""
    from pyspark.sql.window import Window

    rows, found = df.repartition("frame"), [F.col(value)]
    for level in range(1, levels + 1):
        block = Window.partitionBy("frame", F.shiftright(F.col("y"), level), F.shiftright(F.col("x"), level))
        found.append(F.avg(value).over(block))
    return rows.withColumn(name, F.coalesce(*found))
