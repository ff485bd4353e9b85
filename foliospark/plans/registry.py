"""Registered queries, each next to the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.driver_tables import DriverTables
from foliospark.plans.oracle_tables import ORACLE_TABLES
from foliospark.session import tune_session

Build = Callable[[DriverTables], DataFrame]

_BUILDS: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; without ``sql`` only its rows are checked."""

    def add(build: Build) -> Build:
        if name in _BUILDS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDS[name] = build
        if sql is not None:
            _ORACLES[name] = with_tables(sql)
        return build

    return add


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the platform tables it mentions, in order."""
    needed: set[str] = set()
    text = sql
    for name in reversed(ORACLE_TABLES):
        body = text + " ".join(ORACLE_TABLES[n] for n in needed)
        if re.search(rf"\b{name}\b", body):
            needed.add(name)
    tables = [f"{n} AS ({ORACLE_TABLES[n]})" for n in ORACLE_TABLES if n in needed]
    sql = sql.strip()
    if not tables:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(tables)
    if sql.upper().startswith("WITH RECURSIVE "):
        return head + ",\n" + sql[len("WITH RECURSIVE ") :]
    if sql.upper().startswith("WITH "):
        return head + ",\n" + sql[len("WITH ") :]
    return head + "\n" + sql


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and timestamps as epoch seconds."""

    def column(name: str, kind: str):
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        if kind == "timestamp":
            return F.unix_timestamp(name).alias(name)
        return F.col(name)

    return df.select(*[column(name, kind) for name, kind in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(build(DriverTables(tune_session(spark), sf_dir)))

        return run

    return {name: runner(build) for name, build in _BUILDS.items()}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
