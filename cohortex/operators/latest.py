"""Latest version of every logical record in a landing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str, tie: str | None = None) -> DataFrame:
    """One row for each ``key``: the one with the latest ``version``.

    A null version is older than any other; ties go to the largest ``tie``.
    Rows with a null key belong to no record and are left out.  The filter on
    ``row_number`` lets Spark put a group limit before the shuffle, so a record
    sent a million times leaves every map task at most once.
    """
    order = [F.col(version).desc_nulls_last()] + ([F.col(tie).desc_nulls_last()] if tie else [])
    rank = "__latest_rank"
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def valid_records(df: DataFrame, *columns: str) -> DataFrame:
    """The current rows of the client-month landing table, only ``columns`` (and ``registro_id``)."""
    keep = list(dict.fromkeys(("registro_id", "fecha_carga", "fila_id", *columns)))
    return latest_rows(df.select(*keep), "registro_id", "fecha_carga", "fila_id").select(*dict.fromkeys(("registro_id", *columns)))
