"""Compare a named query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, folder: str, con, fn, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, {sorted(df.columns)}: {wrong[:2]}"
    return None
