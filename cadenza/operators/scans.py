"""Sequential rules, whole or split.

`fold` runs any rule, a key in one task. `scan` runs rules of which a stretch of rows is itself a small value, from state
to state: a key's stretches are summed up in as many tasks, their summaries, a row each, give every stretch its start,
and the stretches run from there, again in as many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Numbers of the order that a stretch spans.
SPAN = 65_536

Numbers = list[float]


class Rule(NamedTuple):
    """A rule over rows in order; columns come as lists of a piece of a stretch, and a state of None is a key's start.

    along: state and columns to result columns and state. through: what the rows before did to a state (None: there are
    none) and columns, to what they do together; apply: that on a state.
    """

    reads: Sequence[str]
    fields: str
    along: Callable[..., tuple[list[list], Numbers]]
    through: Callable[..., Numbers]
    apply: Callable[[Numbers, Numbers], Numbers]


def fold(df: DataFrame, keys: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict]], fields: str, columns: list[str], order: str = "frame") -> DataFrame:
    """The rows with new columns that a sequential rule makes: `step` takes the state and a row, and gives both anew.

    Rows are dealt by key and sorted within partitions, and stream by in Arrow batches; the state is a few scalars, so
    a session may be of any length. One session is one task's.
    """
    added = T.StructType.fromDDL(fields)
    schema, types = T.StructType([*(df.schema[c] for c in columns), *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start()
                state, new = step(state, row)
                made.append(new)
            new_columns = [pa.array([m[f.name] for m in made], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *new_columns], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Begin and end of each run of rows of one stretch."""
    codes = [c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in batch.column("_at").flatten()]
    new = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
    edges = [0, *new.tolist(), batch.num_rows]
    return list(zip(edges[:-1], edges[1:], strict=True))


def scan(df: DataFrame, keys: Sequence[str], rule: Rule, columns: Sequence[str], order: str = "frame", span: int = SPAN) -> DataFrame:
    """`columns` of the rows and the rule's results. `order` is a whole number, unique in its key; gaps are allowed.

    A key may hold a third of the rows: no task holds more than `span` numbers of it at a time, and one task a key sees
    a row per stretch. Null keys are keys; what the rule reads is not null. Only stretches that another follows are
    summed up, so where keys are short the rule runs once. Rows are dealt once and read from there, `df` is read once.
    """
    added = T.StructType.fromDDL(rule.fields)
    types = to_arrow_schema(added)
    kept = list(dict.fromkeys([order, *rule.reads, *columns]))
    at = F.struct(*keys, F.floor(F.col(order) / span).alias("_stretch")).alias("_at")
    rows = df.select(at, *kept).repartition("_at")
    numbers = T.ArrayType(T.DoubleType())
    summary_schema = T.StructType([T.StructField("_next", rows.schema["_at"].dataType), T.StructField("_map", numbers), T.StructField("_alone", numbers)])
    summary_types = to_arrow_schema(summary_schema)
    out_schema = T.StructType([*(df.schema[c] for c in columns), *added.fields])

    def pieces(batches: Iterator[pa.RecordBatch], beside: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, Any, list[list]]]]]:
        """Batches and their pieces: whether a stretch begins there, the value of `beside`, and the lists of columns."""
        last = None
        for batch in batches:
            if batch.num_rows:
                ends, lists = _pieces(batch), [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in rule.reads]
                said = batch.column(beside).take(pa.array([a for a, _ in ends])).to_pylist()
                begins = batch.column("_at")[0].as_py() != last
                yield batch, [(i > 0 or begins, own, [c[a:b] for c in lists]) for i, ((a, b), own) in enumerate(zip(ends, said, strict=True))]
                last = batch.column("_at")[batch.num_rows - 1].as_py()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # not in SQL, which would leave out columns, and so deal the rows a second time
        for batch in batches:
            parts, fields = batch.column("_at").flatten(), list(batch.schema.field("_at").type)
            own = pa.table(parts, pa.schema(fields)).group_by([f.name for f in fields], use_threads=False).aggregate([]).combine_chunks()
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([own.column(f.name).chunk(0) for f in fields], fields=fields)], ["_at"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for _, parts in pieces(batches, "_next"):
            done = []
            for begins, after, piece in parts:
                if begins:
                    done += [now] if now else []
                    now = {"_next": after, "_map": None, "_alone": None}
                now["_map"], now["_alone"] = rule.through(now["_map"], *piece), rule.along(now["_alone"], *piece)[1]
            yield pa.RecordBatch.from_pylist(done, summary_types)
        yield pa.RecordBatch.from_pylist([now] if now else [], summary_types)

    def enter(state: Numbers | None, row: dict) -> tuple[Numbers, dict]:
        end = row["_alone"] if state is None else rule.apply(row["_map"], state)
        return end, {"_start": end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch, parts in pieces(batches, "_start"):
            made = [[] for _ in types]
            for begins, start, piece in parts:
                results, state = rule.along(start if begins else state, *piece)
                for whole, part in zip(made, results, strict=True):
                    whole.extend(part)
            new = [pa.array(m, f.type) for m, f in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], out_schema.names)

    names = [f"_key{i}" for i in range(len(keys))]
    own = [F.col("_at").getField(k) for k in keys]
    after = F.lead("_at._stretch").over(Window.partitionBy(*own).orderBy("_at._stretch"))
    followed = rows.mapInArrow(seen, T.StructType([rows.schema["_at"]])).distinct().withColumn("_after", after).where("_after is not null")
    followed = followed.select("_at", F.struct(*(c.alias(k) for c, k in zip(own, keys, strict=True)), F.col("_after").alias("_stretch")).alias("_next"))
    summaries = rows.join(followed, "_at").sortWithinPartitions("_at", order).mapInArrow(summed, summary_schema)
    summaries = summaries.select(F.col("_next").alias("_at"), "_map", "_alone", F.col("_next._stretch").alias("_n"), *(F.col("_next").getField(k).alias(n) for k, n in zip(keys, names, strict=True)))
    starts = fold(summaries, names, lambda: None, enter, "_start array<double>", ["_at"], order="_n")
    return rows.join(starts, "_at", "left").sortWithinPartitions("_at", order).mapInArrow(run, out_schema)


def weighted(share: str, values: Sequence[str], results: Sequence[str]) -> Rule:
    """Each of `values` mixed with its last result, which has the row's `share`; the first is taken whole.

    A row is an affine map of the last result, and so is a stretch: the product of its shares, and a sum.
    """

    def along(state: Numbers | None, shares: list[float], *columns: list[float]) -> tuple[list[list], Numbers]:
        made = []
        for i, column in enumerate(columns):
            last, new = None if state is None else state[i], []
            for value, s in zip(column, shares, strict=True):
                last = value if last is None else value * (1 - s) + last * s
                new.append(last)
            made.append(new)
        return made, [m[-1] for m in made]

    def through(does: Numbers | None, shares: list[float], *columns: list[float]) -> Numbers:
        product, *sums = does or [1.0, *(0.0 for _ in columns)]
        for i, column in enumerate(columns):
            total = sums[i]
            for value, s in zip(column, shares, strict=True):
                total = value * (1 - s) + total * s
            sums[i] = total
        for s in shares:
            product *= s
        return [product, *sums]

    def apply(does: Numbers, state: Numbers) -> Numbers:
        return [does[0] * last + total for last, total in zip(state, does[1:], strict=True)]

    return Rule([share, *values], ", ".join(f"{r} double" for r in results), along, through, apply)


def scheduled(cut: str, early: str, interval: int, least: int) -> Rule:
    """refresh, since: a refresh at the start, at a cut, after `interval` rows, or after `least` where a row is early.

    The state is how many rows ago the last was, below `interval`; a stretch is a table from such numbers to others.
    Rows that are neither cut nor early only turn the table.
    """

    def along(state: Numbers | None, cuts: list[bool], earlies: list[bool]) -> tuple[list[list], Numbers]:
        since, fresh, counts = interval - 1 if state is None else int(state[0]), [], []
        for c, e in zip(cuts, earlies, strict=True):
            now = c or since >= interval - 1 or (e and since >= least - 1)
            since = 0 if now else since + 1
            fresh.append(now)
            counts.append(since)
        return [fresh, counts], [float(since)]

    def through(does: Numbers | None, cuts: list[bool], earlies: list[bool]) -> Numbers:
        table = np.arange(interval) if does is None else np.array(does, int)
        cut_at, done = np.flatnonzero(cuts), 0
        if cut_at.size:
            table, done = np.zeros(interval, int), int(cut_at[-1]) + 1
        for at in (np.flatnonzero(earlies[done:]) + done).tolist():
            if table.min() == table.max():
                break
            table = (table + at - done) % interval
            table = np.where(table >= least - 1, 0, (table + 1) % interval)
            done = at + 1
        if table.min() == table.max():
            (end,) = along([table[0]], cuts[done:], earlies[done:])[1]
            return [end] * interval
        return ((table + len(cuts) - done) % interval).astype(float).tolist()

    def apply(does: Numbers, state: Numbers) -> Numbers:
        return [does[int(state[0])]]

    return Rule([cut, early], "refresh boolean, since long", along, through, apply)


def following(target: str, result: str, falling: float, rising: float, low: float, high: float) -> Rule:
    """A level that goes to each target by the share `falling` or `rising`; it starts at the first.

    A row is a rising map of the level with a bend at its target, so a stretch is one of straight pieces, here its bends
    from `low` to `high`. Each row brings the ends nearer, so bends stop to come after some hundred rows, where
    the map is flat. A target outside [low, high] is an error.
    """

    def along(state: Numbers | None, targets: list[float]) -> tuple[list[list], Numbers]:
        if targets and not low <= min(targets) <= max(targets) <= high:
            raise ValueError(f"a target outside [{low}, {high}]")
        level, made = None if state is None else state[0], []
        for t in targets:
            level = t if level is None else level + (t - level) * (falling if t < level else rising)
            made.append(level)
        return [made], [level] if made else state

    def through(does: Numbers | None, targets: list[float]) -> Numbers:
        points = does or [low, low, high, high]
        x, y = np.array(points[::2]), np.array(points[1::2])
        for i, t in enumerate(targets):
            if y[-1] - y[0] <= 1e-15 * max(abs(low), abs(high)):
                (end,) = along([float(y[0])], targets[i:])[1]
                return [low, end, high, end]
            if y[0] < t < y[-1] and t not in y:
                place = int(np.searchsorted(y, t))
                x, y = np.insert(x, place, np.interp(t, y, x)), np.insert(y, place, t)
            y = y + (t - y) * np.where(t < y, falling, rising)
        return np.column_stack([x, y]).ravel().tolist()

    def apply(does: Numbers, state: Numbers) -> Numbers:
        return [float(np.interp(state[0], does[::2], does[1::2]))]

    return Rule([target], f"{result} double", along, through, apply)
