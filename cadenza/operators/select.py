"""Selection: best of a group with explicit ties, coalescing, set operations on keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best(rows: DataFrame, keys: Sequence[str], score: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """Per key the row with the highest positive score; of equals, the first in order. A maximum of structs: it combines before the shuffle."""
    s = rows.withColumn("score", score).where("score > 0")
    top = F.max(F.struct("score", (-F.col(order)).alias("_first"), *columns)).alias("top")
    return s.groupBy(*keys).agg(top).select(*keys, "top.score", *(f"top.{c}" for c in columns))


def distinct_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias("first_at"))


def coalesced(rows: DataFrame, keys: Sequence[str], order: str, member: Column) -> DataFrame:
    """Of each run of members, only the last row; all other rows stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_m", member).withColumn("_next", F.lead("_m").over(w)).where(~(F.col("_m") & F.coalesce("_next", F.lit(False)))).drop("_m", "_next")


def last_rows(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in the place of those of equal key."""
    return old.join(new, key, "left_anti").unionByName(new)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    """A mask with gaps of up to 2 radius cells closed: grown by `radius`, then shrunk by it; the border does not shrink it."""

    def grown(m: np.ndarray, edge: bool) -> np.ndarray:
        p = np.pad(m, radius, constant_values=edge)
        return np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1, 2 * radius + 1)).any(axis=(2, 3))

    return ~grown(~grown(mask, False), False) if mask.size else mask


def merged_boxes(boxes: list[tuple[int, int, int, int]], most: int, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1), the two with the nearest centres, as shares of the grid, merged in the first one's place until `most` remain; sorted by corner."""
    boxes = list(boxes)
    while len(boxes) > most:
        centre = np.array([((a + c) / 2 / width, (b + d) / 2 / height) for a, b, c, d in boxes])
        d = ((centre[:, None] - centre[None]) ** 2).sum(axis=2) + np.where(np.tri(len(boxes), dtype=bool), np.inf, 0)
        i, j = divmod(int(d.argmin()), len(boxes))
        a, b = boxes[i], boxes.pop(j)
        boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    return sorted(boxes)


def tiles(mask: np.ndarray, core: int, halo: int, reach: int, snap: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Disjoint cores (x0, y0, x1, y1) that own every cell within `reach` of a set one, each with its outer box.

    Cores are active blocks, joined along rows up to two wide and then, where both ends agree, down to three high. The
    outer box is the core with `halo` about it, snapped outwards to multiples of `snap` and cut to the grid.
    """
    h, w = mask.shape
    near = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        near[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1] = True
    bands: dict[tuple[int, int], list[list[int]]] = {}
    for y in range(0, h, core):
        active, x = [bool(near[y : y + core, x : x + core].any()) for x in range(0, w, core)], 0
        while x < len(active):
            wide = 1 + (x + 1 < len(active) and active[x + 1])
            if active[x]:
                column = bands.setdefault((x * core, min((x + wide) * core, w)), [])
                end = min(y + core, h)
                if column and column[-1][1] == y and end - column[-1][0] <= 3 * core:
                    column[-1][1] = end
                else:
                    column.append([y, end])
                x += wide
            else:
                x += 1
    cores = sorted((y0, x0, x1, y1) for (x0, x1), column in bands.items() for y0, y1 in column)
    down, up = (lambda v: max(0, (v - halo) // snap * snap)), (lambda v, most: min(most, -(-(v + halo) // snap) * snap))
    return [(x0, y0, x1, y1, down(x0), down(y0), up(x1, w), up(y1, h)) for y0, x0, x1, y1 in cores]


def grid_of(values: list[float | None] | None) -> np.ndarray:
    """A square grid of a list's values, row by row; what the list leaves open, and null cells, are not numbers. A null list is an empty grid."""
    flat = np.array([] if values is None else values, np.float64)
    side = math.isqrt(max(len(flat) - 1, 0)) + 1 if len(flat) else 0
    return np.pad(flat, (0, side * side - len(flat)), constant_values=np.nan).reshape(side, side)


def per_grid(df: DataFrame, make, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """Rows (frame, ...) that `make` gives for each grid of (frame, values), batch by batch."""

    def run(batches):
        for batch in batches:
            rows = [(f, *r) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in make(grid_of(v))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(run, schema)
