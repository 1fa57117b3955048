"""Hold a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def cell(x):
    """A value as it is compared: floats to nine digits, times without zone, containers as text."""
    if x is None or isinstance(x, (bool, int)):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    found = db.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def difference(df, sf_dir: str, sql: str) -> str:
    """What differs, or the empty string."""
    columns, rows = rows_of(df.columns, df.collect())
    want_columns, want = duck(sf_dir, sql)
    if columns != want_columns:
        return f"columns {columns} instead of {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows instead of {len(want)}"
    wrong = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(wrong)} of {len(want)} rows differ, first {str(wrong[0])[:600]} in {columns}" if wrong else ""
