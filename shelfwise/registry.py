"""All queries of the engine with their DuckDB oracles."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from shelfwise import catalog, plans


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The biggest drops now on offer."""
    return queries()["RANK-11_rails"](spark, sf_dir)


def queries() -> dict:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(catalog.ORACLES)
