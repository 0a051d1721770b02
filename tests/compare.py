"""Compare a Spark result with the SQL result of the same query."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(x: object) -> object:
    if isinstance(x, bool) or x is None or isinstance(x, str | date | datetime):
        return x
    if isinstance(x, float):
        return ("float", "nan" if math.isnan(x) else repr(x))
    if isinstance(x, Decimal):
        return ("decimal", x)
    return ("int", int(x))


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, cells with their type, rows in any fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def spark_table(df) -> tuple[list[str], list[tuple]]:
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())


def difference(left, right) -> str | None:
    """A short account of how two tables differ, None if they are equal."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    wrong = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
