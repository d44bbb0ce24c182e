"""Comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, list):
        return [plain(item) for item in value]
    return value


def kind(value) -> str:
    return type(value).__name__


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    found = [tuple(plain(row[place]) for place in order) for row in rows]
    return sorted(found, key=lambda row: [(value is not None, str(value)) for value in row])


def differences(spark_frame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = connection.execute(sql)
    sql_columns = [entry[0] for entry in result.description]
    expected = rows_of(sql_columns, result.fetchall())
    actual = rows_of(spark_frame.columns, [tuple(row) for row in spark_frame.collect()])
    if sorted(sql_columns) != sorted(spark_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} instead of {sorted(sql_columns)}"]
    if len(expected) != len(actual):
        return [f"{len(actual)} rows instead of {len(expected)}"]
    found = []
    for left, right in zip(actual, expected):
        if left != right or [kind(v) for v in left if v is not None] != [kind(v) for v in right if v is not None]:
            found.append(f"{left} instead of {right}")
    return found
