"""A register of queries: each operator's query under its inventory id, with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the derived tables as the query ``name``; ``sql`` states the same for DuckDB."""
    from shelfwise.sources.tables import ORACLE_TABLES, Tables

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{ORACLE_TABLES}\n{sql.strip()}"
        return fn

    return register
