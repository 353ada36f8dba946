"""Registry of the queries of this subpackage, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_MODULES = (
    "decontaminate line_templates packing token_files token_counts language suffixes near_dups vector_search "
    "url_rules hard_negatives fill_middle secrets"
).split()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    for name in _MODULES:
        import_module(f"{__package__}.{name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
