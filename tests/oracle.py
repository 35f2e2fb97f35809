"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float):
        return f"{float(x):.9g}"
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


def same(df, sql, sf_dir):
    made = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(made.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(made.columns, made.fetchall())
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, different[:3]
