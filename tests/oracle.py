"""Comparing a query with its SQL in DuckDB, whatever the order of rows and columns."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if not isinstance(value, (bool, int, str, type(None))) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def compare(df, con, sql: str) -> tuple[Counter, Counter, list[str], list[str]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cursor.fetchall()), sorted(df.columns), sorted(names)
