"""Queries and SQL of this subpackage's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.operators.latest import valid_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VALID_SQL = """v AS (SELECT * FROM competencia_01 WHERE registro_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY registro_id ORDER BY fecha_carga DESC NULLS LAST, fila_id DESC NULLS LAST) = 1)"""


def query(f=None, *, sql: str | None = None):
    def add(g):
        QUERIES[g.__name__] = g
        if sql:
            SQL[g.__name__] = sql
        return g

    return add(f) if f else add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def panel(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return valid_records(table(spark, sf, "competencia_01"), *columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cohortex.llm import queries_panel, queries_text  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
