"""Registry of queries: each module of this package adds its (name, query, SQL) rows here."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its DuckDB SQL if SQL can express it."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _SQL


#: Modules of this package that register queries.
MODULES = ("scalars", "windows", "trees", "finding", "upkeep", "fleet", "logged", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f".{name}", __package__)
