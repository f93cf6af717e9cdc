"""Holds a query's rows against DuckDB's, as multisets with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in values)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sf_dir: str, sql: str) -> None:
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = rows(*duck(sf_dir, sql))
    assert names == want_names
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
