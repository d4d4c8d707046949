"""The registered queries of the core, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Modules that register queries when imported.
MODULES = ("rolling", "relational", "features", "scoring", "analysis", "workflow", "io")


def query(f=None, *, sql: str | None = None):
    """Register ``f`` under its name, with its SQL if there is one."""

    def add(g):
        QUERIES[g.__name__] = g
        if sql:
            SQL[g.__name__] = sql
        return g

    return add(f) if f else add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        import_module(f"cohortex.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
