"""Geometry as column expressions: integer divisions, half-even rounding, exact ratios as pairs of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(a: Column, b: int) -> Column:
    """Floor division."""
    return F.floor(a / b)


def even(x: Column) -> Column:
    """The even number at or under x, at least 2."""
    return 2 * F.greatest(F.lit(1), F.floor(x / 2))


def multiple_of_four(x: Column) -> Column:
    return 4 * F.greatest(F.lit(16), F.floor(x / 4))


def frame_bytes(w: Column, h: Column, packing: Column) -> Column:
    """Bytes of a packed frame: planar 4:2:0, or three bytes a pixel."""
    return F.when(packing == "nv12", div(w * h * 3, 2)).otherwise(w * h * 3)


def guide(w: Column, h: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """(tile, columns, rows) of a low-resolution grid."""
    tile = F.ceil(w / F.greatest(F.lit(64), wanted))
    return tile, F.ceil(w / tile), F.ceil(h / tile)


def scaled_guide(w: Column, h: Column, side: Column) -> tuple[Column, Column]:
    """Size whose longer side is at most `side`, in multiples of 8, at least 128."""
    scale = F.least(F.lit(1.0), F.greatest(F.lit(128), side) / F.greatest(w, h))
    one = lambda x: F.greatest(F.lit(128), F.bround(x * scale / 8) * 8).cast("long")
    return one(w), one(h)


def layout(w: Column, h: Column, kind: Column) -> list[Column]:
    """eye_w, eye_h, packed_w, packed_h of a stereo layout."""
    half_w, half_h = div(w, 2), div(h, 2)
    pick = lambda hs, fs, hu, fu: F.when(kind == "half-sbs", hs).when(kind == "full-sbs", fs).when(kind == "half-ou", hu).otherwise(fu).cast("long")
    return [pick(half_w, w, w, w), pick(h, h, half_h, h), pick(half_w * 2, w * 2, w, w), pick(h, h, half_h * 2, h * 2)]


def fit(w: Column, h: Column, most_w: Column, most_h: Column, grow: Column) -> tuple[Column, Column]:
    """Even size within a box; enlarged only if allowed."""
    scale = F.least(most_w / w, most_h / h)
    scale = F.when(grow, scale).otherwise(F.least(F.lit(1.0), scale))
    return even(w * scale).cast("long"), even(h * scale).cast("long")


def model_canvas(w: Column, h: Column, side: int, step: int = 64) -> list[Column]:
    """inner_w, inner_h, canvas_w, canvas_h, pad_x, pad_y: an even inner size, centred on a canvas of multiples of `step`."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    inner = [even(x * scale).cast("long") for x in (w, h)]
    canvas = [(F.ceil(x / step) * step).cast("long") for x in inner]
    return [*inner, *canvas, *(div(c - i, 2).cast("long") for c, i in zip(canvas, inner, strict=True))]


def tiers(value: Column, table: list[tuple[float, tuple[int, ...]]], clamp: Column | None = None) -> Column:
    """The values of the highest tier that `value` reaches, as an array."""
    out = F.array(*map(F.lit, table[0][1]))
    for least, values in table[1:]:
        out = F.when(value >= least, F.array(*map(F.lit, values))).otherwise(out)
    return out


def warp_steps(divergence: Column, symmetric: Column) -> Column:
    """One step up to 5, then one for every 4, at least 2; an anchored eye counts double."""
    d = divergence * F.when(symmetric, 1).otherwise(2)
    return F.when(d <= 5, 1).otherwise(F.greatest(F.lit(2), F.ceil(d / 4))).cast("int")


def shift_factors(anchor: Column) -> tuple[Column, Column]:
    return F.when(anchor == "left", 0.0).when(anchor == "right", 1.0).otherwise(0.5), F.when(anchor == "left", -1.0).when(anchor == "right", 0.0).otherwise(-0.5)


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of overlapping tiles; the last one ends at the end."""
    last = F.greatest(length - tile, F.lit(0)).cast("long")
    return F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), F.array(last))


def padded_count(n: Column) -> Column:
    return F.greatest(F.lit(25), F.ceil((n + 3) / 8) * 8 + 1).cast("long")


def bounded_square(cx: Column, cy: Column, side: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Corner of a square about a centre, half-even, inside the frame."""
    one = lambda c, size: F.greatest(F.lit(0), F.least(F.bround(c - side / 2), size - side)).cast("long")
    return one(cx, w), one(cy, h)


def plan(jobs: DataFrame) -> DataFrame:
    """Preflight of stereo jobs (w, h, mode, packing, codec, cap, ipd): eye and output size, and what is wrong with them.

    mode: source, or a height to fit in a 16:9 box (a portrait swaps the box). The scale is an exact ratio: sides are
    compared by products of integers, then floored to even numbers. A cap limits the width a fill works at, an eye
    distance pads the width, the packing sets the final size, and limits depend on the codec.

    Every step is a column of its own, so that later ones refer to it and do not repeat it.
    """
    c = F.col
    box = F.when(c("mode") == "source", F.lit(0)).otherwise(c("mode").try_cast("long"))
    df = jobs.withColumn("_h", box).withColumn("_w", div(c("_h") * 16, 9).cast("long")).withColumn("_tall", c("h") > c("w"))
    df = df.withColumn("_bw", F.when(c("_tall"), c("_h")).otherwise(c("_w"))).withColumn("_bh", F.when(c("_tall"), c("_w")).otherwise(c("_h")))
    by_width = c("_bw") * c("h") <= c("_bh") * c("w")  # bw / w <= bh / h
    df = df.withColumn("_num", F.when(by_width, c("_bw")).otherwise(c("_bh"))).withColumn("_den", F.when(by_width, c("w")).otherwise(c("h")))
    unchanged = (c("mode") == "source") | (c("_num") >= c("_den"))
    fitted = lambda x: F.when(unchanged, c(x)).otherwise(F.floor(c(x) * c("_num") / c("_den") / 2) * 2).cast("long")
    df = df.withColumn("_fw", fitted("w")).withColumn("_fh", fitted("h")).withColumn("_capped", (c("cap") > 0) & (c("_fw") > c("cap")))
    df = df.withColumn("_cw", c("cap") + c("cap") % 2).withColumn("_ch", F.floor(c("_cw") * c("_fh") / c("_fw")))
    df = df.withColumn("_iw", F.when(c("_capped"), c("_cw")).otherwise(c("_fw"))).withColumn("eye_h", F.when(c("_capped"), c("_ch") + c("_ch") % 2).otherwise(c("_fh")).cast("long"))
    df = df.withColumn("_pad", F.floor(F.abs(c("ipd")) * F.greatest("_iw", "eye_h") / 100)).withColumn("eye_w", (c("_iw") + 3 * (c("_pad") - c("_pad") % 2)).cast("long"))
    across = F.when(c("packing") == "full-sbs", c("eye_w") * 2).when(c("packing") == "half-sbs", div(c("eye_w"), 2) * 2).otherwise(c("eye_w"))
    down = F.when(c("packing") == "full-ou", c("eye_h") * 2).when(c("packing") == "half-ou", div(c("eye_h"), 2) * 2).otherwise(c("eye_h"))
    df = df.withColumn("out_w", across.cast("long")).withColumn("out_h", down.cast("long")).withColumn("_limit", F.when(c("codec") == "h264", 4096).otherwise(8192))
    wrong = F.array(F.when((c("out_w") % 2 != 0) | (c("out_h") % 2 != 0), "odd"), F.when(c("out_w") > c("_limit"), "wide"), F.when(c("out_h") > c("_limit"), "high"), F.when(F.least("eye_w", "eye_h") < 64, "small"))
    return df.select(*jobs.columns, "eye_w", "eye_h", "out_w", "out_h", F.array_compact(wrong).alias("errors"))
