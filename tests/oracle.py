"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, sf_dir: str = SF) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    con = duck(sf_dir).execute(sql)
    columns = [c[0] for c in con.description]
    want = con.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(rows_of(df.columns, got), rows_of(columns, want), strict=True):
        assert a == b, (a, b)
    return len(got)
