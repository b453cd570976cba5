"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> tuple[int, list, list]:
    """(rows, only in Spark, only in DuckDB); fails when the columns differ."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = bag(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    actual = bag(df.columns, df.collect())
    return sum(actual.values()), list((actual - expected).items())[:5], list((expected - actual).items())[:5]
