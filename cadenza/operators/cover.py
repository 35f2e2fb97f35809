"""Covers of grid masks by few squares.

Where squares may stand follows from the boxes of a mask's components, so candidates are columns: sequences of starts
along each axis, crossed. Which squares to take is a lazy greedy choice: gains come from a summed-area table in four
reads, and as they only shrink while cells get covered, an old gain is an upper bound. A heap holds those bounds, and
only what stands on top is counted anew.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Areas:
    """Set cells of any rectangle of a mask, from its summed-area table."""

    def __init__(self, mask: np.ndarray):
        self.table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
        np.cumsum(np.cumsum(mask, axis=0), axis=1, out=self.table[1:, 1:])

    def of(self, squares: np.ndarray) -> np.ndarray:
        """Of rows (x0, y0, side), cut to the grid."""
        h, w = (n - 1 for n in self.table.shape)
        x, y, side = squares.T
        x0, y0, x1, y1 = np.clip(x, 0, w), np.clip(y, 0, h), np.clip(x + side, 0, w), np.clip(y + side, 0, h)
        t = self.table
        return t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0]


def lazy_cover(mask: np.ndarray, squares: np.ndarray, share: float, most: int, least: int) -> list[tuple[int, int, int, int]]:
    """Squares (x0, y0, side, gain): again and again that with the most uncovered cells, the first of equals.

    It ends when `share` of the cells is covered (at least `least`), at `most` squares, or when none gains `least` cells.
    """
    left, out = mask.copy(), []
    areas, covered = Areas(left), 0
    total = int(areas.table[-1, -1])
    enough = max(least, math.ceil(total * share))
    heap = [(-int(g), i, 0) for i, g in enumerate(areas.of(squares)) if g >= least] if len(squares) else []
    heapq.heapify(heap)
    while heap and covered < enough and len(out) < most:
        bound, i, counted = heapq.heappop(heap)
        if counted < len(out):
            gain = int(areas.of(squares[i : i + 1])[0])
            if gain >= least:
                heapq.heappush(heap, (-gain, i, len(out)))
            continue
        x, y, side = (int(v) for v in squares[i])
        left[y : y + side, x : x + side] = False
        areas, covered = Areas(left), covered - bound
        out.append((x, y, side, -bound))
    return out


def greedy_cover(mask: np.ndarray, side: int, share: float = 0.985, most: int = 4, least: int = 1) -> list[tuple[int, int, int]]:
    """Squares (x0, y0, gain) of one size that cover a mask, from all places, row by row."""
    h, w = mask.shape
    y, x = np.mgrid[: max(1, h - side + 1), : max(1, w - side + 1)]
    squares = np.stack([x.ravel(), y.ravel(), np.full(x.size, side)], axis=1)
    return [(a, b, gain) for a, b, _, gain in lazy_cover(mask, squares, share, most, least)]


def axis_starts(low: Column, high: Column, side: Column, overlap: int, size: Column) -> Column:
    """Where squares of `side` start from low to high: every side - overlap, and flush with the end; a single one, centred, if one is enough."""
    inside = lambda v: F.greatest(F.lit(0), F.least(size - side, v)).cast("int")
    stride = F.greatest(F.lit(1), side - overlap)
    many = F.array_sort(F.array_distinct(F.concat(F.sequence(low.cast("int"), F.greatest(low, high - side).cast("int"), stride.cast("int")), F.array(inside(high - side)))))
    return F.when(high - low <= side, F.array(inside(F.rint((low + high - side) / 2)))).otherwise(many)


def _crossed(rows: Column, columns: Column, side: Column) -> Column:
    square = lambda x, y: F.struct(x.alias("x0"), y.alias("y0"), side.cast("int").alias("side"), F.lit(True).alias("tile"))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: square(x, y))))


def candidates(parts: Column, height: Column, width: Column, side: int, overlap: int, context: float, snap: int, smallest: int) -> Column:
    """The squares that may cover `parts` (structs x0, y0, x1, y1, cx, cy; ends included), in order of preference.

    About each part a square of `context` times its longer side, in steps of `snap` and not under `smallest`, with its
    centre on the part's mean; if that is over `side`, squares of `side` across the part and a margin (`tile` is true).
    Then squares of `side` across all parts together.
    """
    most = F.least(F.lit(side), height, width)

    def across(x0: Column, y0: Column, x1: Column, y1: Column, margin: Column) -> Column:
        rows = axis_starts(F.greatest(F.lit(0), y0 - margin), F.least(height, y1 + 1 + margin), most, overlap, height)
        return _crossed(rows, axis_starts(F.greatest(F.lit(0), x0 - margin), F.least(width, x1 + 1 + margin), most, overlap, width), most)

    def of(p: Column) -> Column:
        longer = F.greatest(p["x1"] - p["x0"], p["y1"] - p["y0"]) + 1
        need = (F.ceil(F.greatest(F.lit(float(smallest)), context * longer) / snap) * snap).cast("int")
        corner = lambda centre, size: F.greatest(F.lit(0), F.least(size - need, F.rint(centre - need / 2))).cast("int")
        own = F.struct(corner(p["cx"], width).alias("x0"), corner(p["cy"], height).alias("y0"), need.alias("side"), F.lit(False).alias("tile"))
        margin = F.floor((context - 1) * most / 2).cast("int")
        return F.when(need <= most, F.array(own)).otherwise(across(p["x0"], p["y0"], p["x1"], p["y1"], margin))

    end = lambda f, c: f(F.transform(parts, lambda p: p[c]))
    together = across(end(F.array_min, "x0"), end(F.array_min, "y0"), end(F.array_max, "x1"), end(F.array_max, "y1"), F.lit(overlap // 2))
    return F.when(F.size(parts) > 0, F.concat(F.flatten(F.transform(parts, of)), together))


def masks(df: DataFrame, of: Callable[[list], np.ndarray], components: Callable[[np.ndarray], list], least: int) -> DataFrame:
    """frame, height, width, mask, wanted, parts of rows (frame, values): the mask that `of` makes, its components of `least` cells and more, and their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for frame, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mask = of(values)
                wanted, parts = np.zeros_like(mask), []
                for ys, xs in components(mask):
                    if len(ys) >= least:
                        wanted[ys, xs] = True
                        parts.append({"x0": int(xs.min()), "y0": int(ys.min()), "x1": int(xs.max()), "y1": int(ys.max()), "cx": float(xs.mean()), "cy": float(ys.mean())})
                rows.append({"frame": frame, "height": mask.shape[0], "width": mask.shape[1], "mask": np.packbits(mask).tobytes(), "wanted": np.packbits(wanted).tobytes(), "parts": parts})
            yield pa.RecordBatch.from_pylist(rows, schema)

    part = pa.struct([*((c, pa.int32()) for c in ("x0", "y0", "x1", "y1")), ("cx", pa.float64()), ("cy", pa.float64())])
    schema = pa.schema([("frame", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("mask", pa.binary()), ("wanted", pa.binary()), ("parts", pa.list_(part))])
    return df.mapInArrow(run, "frame long, height int, width int, mask binary, wanted binary, parts array<struct<x0: int, y0: int, x1: int, y1: int, cx: double, cy: double>>")


def roi_cover(found: DataFrame, side: int, overlap: int, context: float, least: int, most: int, snap: int, smallest: int, share: float = 0.985) -> DataFrame:
    """frame, rank, x0, y0, side, gain: squares over the parts of each of `masks`; smaller parts are left alone. A tile must hold `least` cells of the mask."""
    squares = candidates(F.col("parts"), F.col("height"), F.col("width"), side, overlap, context, snap, smallest)
    rows = found.select("frame", "height", "width", "mask", "wanted", squares.alias("squares")).where("squares is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mask, wanted = (np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["height"] * r["width"]).reshape(r["height"], r["width"]).astype(bool) for c in ("mask", "wanted"))
                places = np.array([(s["x0"], s["y0"], s["side"]) for s in r["squares"]], np.int64)
                tile = np.array([s["tile"] for s in r["squares"]])
                chosen = lazy_cover(wanted, places[~tile | (Areas(mask).of(places) >= least)], share, most, least)
                out += [(r["frame"], i, *c) for i, c in enumerate(chosen)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.int32()] * 5], strict=True)], ["frame", "rank", "x0", "y0", "side", "gain"])

    return rows.mapInArrow(run, "frame long, rank int, x0 int, y0 int, side int, gain int")
