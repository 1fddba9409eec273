"""Compares a query with its SQL on the tables of a folder."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def rows_of_spark(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
