"""Run a registered query and its SQL and compare the rows."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(row) for row in df.select(*names).collect()]


def oracle_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return [names[i] for i in order], rows


def difference(df: DataFrame, connection, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    names, found = spark_rows(df)
    wanted_names, wanted = oracle_rows(connection, sql)
    if names != wanted_names:
        return f"columns {names} against {wanted_names}"
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    key = lambda row: tuple((v is None, type(v).__name__, str(v)) for v in row)
    found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    for ours, theirs in zip(found, wanted):
        if [(type(v), v) for v in ours] != [(type(v), v) for v in theirs]:
            return f"{ours} against {theirs}"
    return None
