"""Closed settings: every key has a rule, and what breaks it is named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    key: str
    kind: str  # number, integer, choice or flag
    default: object
    least: float | None = None
    most: float | None = None
    options: tuple[str, ...] = ()


def problems(settings: Column, rules: Sequence[Rule]) -> Column:
    """Map of key to problem: unknown, type, choice, range. Missing keys take defaults, and so are none."""

    def checked(rule: Rule) -> Column:
        value = F.element_at(settings, rule.key)
        if rule.kind == "choice":
            return F.when(value.isNotNull() & ~value.isin(*rule.options), "choice")
        if rule.kind == "flag":
            return F.when(value.isNotNull() & ~value.isin("true", "false"), "type")
        number = value.try_cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        if rule.kind == "integer":
            bad = bad | (number != F.floor(number))
        return F.when(value.isNotNull() & bad, "type").when((number < rule.least) | (number > rule.most), "range")

    known = [r.key for r in rules]
    found = F.filter(F.array(*(F.struct(F.lit(r.key).alias("key"), checked(r).alias("value")) for r in rules)), lambda e: e["value"].isNotNull())
    unknown = F.transform(F.array_except(F.map_keys(settings), F.array(*map(F.lit, known))), lambda k: F.struct(k.alias("key"), F.lit("unknown").alias("value")))
    return F.map_from_entries(F.concat(found, unknown))


def with_defaults(settings: Column, rules: Sequence[Rule]) -> Column:
    """The settings with every missing key at its default."""
    defaults = F.create_map(*(F.lit(x) for r in rules for x in (r.key, str(r.default))))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(settings, k))
    return F.map_concat(settings, missing)
