"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Modules that register queries.
MODULES = ("record_queries", "study_queries", "space_queries", "model_queries", "invariant_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"latentspark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["procrustes"](spark, sf_dir)
