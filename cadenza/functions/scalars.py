"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rate(text: Column, otherwise: float | None = None) -> Column:
    """`a/b` with b > 0, or a plain number; else `otherwise`."""
    a, b = (F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*$", i).try_cast("double") for i in (1, 2))
    rate = F.when(b > 0, a / b).otherwise(text.try_cast("double"))
    return F.coalesce(rate, F.lit(otherwise).cast("double")) if otherwise is not None else rate


def format_time(seconds: Column) -> Column:
    """hh:mm:ss, or mm:ss under an hour, of seconds rounded up; a dash where there are none."""
    s = F.ceil(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    text = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")) | (seconds < 0), "—").otherwise(text)


def memory_tag(name: Column) -> Column:
    """What follows shm:// if it is made of letters, digits, _ and -; else null."""
    tag = F.regexp_extract(name, r"^shm://([A-Za-z0-9_-]+)$", 1)
    return F.nullif(tag, F.lit(""))


def key_values(line: Column) -> Column:
    """Map of `key=value` pairs that blanks part."""
    return F.str_to_map(line, F.lit(" "), F.lit("="))


def tagged_json(line: Column, schema: str) -> tuple[Column, Column]:
    """Tag and parsed object of a `TAG {json}` line; a byte-order mark is dropped, what cannot be parsed is null."""
    clean = F.regexp_replace(line, "^﻿", "")
    return F.regexp_extract(clean, r"^([A-Z_]+)\s*\{", 1), F.from_json(F.regexp_extract(clean, r"(\{.*)$", 1), schema)


def record(line: Column, names: list[str]) -> Column:
    """Tab-separated fields by name; those that are not there are null."""
    parts = F.split(line, "\t")
    return F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def header_block(headers: Column) -> Column:
    """`key: value` lines of a map, without null and blank values, in order of key."""
    kept = F.map_filter(headers, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    lines = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n")))
    return F.array_join(lines, "")


def cookie_pair(cookie: Column) -> Column:
    """The part before the first semicolon if it is a pair; else null."""
    first = F.trim(F.split(cookie, ";")[0])
    return F.when(first.rlike(r"^[^=;\s]+=[^;]+$"), first)


def in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quantised(x: Column, levels: int = 255) -> Column:
    """Clipped to 0..1, times `levels`, half-even."""
    return F.rint(clamp(x, 0.0, 1.0) * levels).cast("int")


def smoothstep(a: Column) -> Column:
    return a * a * (3 - 2 * a)


def square_iou(ax: Column, ay: Column, bx: Column, by: Column, side: Column) -> Column:
    """Intersection over union of two squares of one side."""
    inter = F.greatest(F.lit(0), side - F.abs(ax - bx)) * F.greatest(F.lit(0), side - F.abs(ay - by))
    return inter / (2 * side * side - inter)


def projected(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    """A homography's image of (x, y); the denominator stays away from zero."""
    d = m[6] * x + m[7] * y + m[8]
    d = F.when(F.abs(d) < 1e-6, 1e-6).otherwise(d)
    return (m[0] * x + m[1] * y + m[2]) / d, (m[3] * x + m[4] * y + m[5]) / d


def shaped(x: Column, comfort: float | None = None) -> Column:
    """Disparity curve: sign * |x| ** .78, or with comfort from tanh(1.8 x) / 1.8 towards tanh(2.2 x) / 2.2."""
    if comfort is None:
        return F.signum(x) * F.pow(F.greatest(F.abs(x), F.lit(1e-6)), F.lit(0.78))
    soft = F.tanh(1.8 * x) / 1.8
    return soft + comfort * (F.tanh(2.2 * x) / 2.2 - soft)


def ini_set(text: Column, key: str, value: str, section: str) -> Column:
    """`key=value` in the place of the key's line, or as a new line below its section."""
    there = text.rlike(rf"(?m)^{key}=")
    return F.when(there, F.regexp_replace(text, rf"(?m)^{key}=.*$", f"{key}={value}")).otherwise(F.regexp_replace(text, rf"(?m)^\[{section}\]$", f"[{section}]\n{key}={value}"))
