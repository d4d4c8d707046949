"""Queries of problems 7 to 9 over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortex.llm.leaks import leaked_items
from cohortex.llm.mixing import Mix, mix_sources
from cohortex.llm.queries import query, table
from cohortex.llm.truncation import cut_records, source_rates


def _leaks(spark: SparkSession, sf: str, **how) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "evaluacion_items"), "item_id", "text", **how)


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


@query
def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks by 12-word runs, and passages in another order that cover half of an item in tiles of five words or more."""
    return _leaks(spark, sf, seed=5, tile=5, coverage=0.5)


@query
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """The test items that leaked, with the number of documents and the best coverage."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("coverage").alias("best_coverage"), F.max("longest").alias("longest"))


def _mix(spark: SparkSession, sf: str) -> Mix:
    return mix_sources(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mezcla_objetivo"), "peso", "max_repeticiones", language="lang")


@query(
    sql=r"""WITH s AS (SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(text, '[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+'))) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT m.source FROM mezcla_objetivo m LEFT JOIN s ON s.source = lower(trim(m.source))
WHERE m.max_repeticiones * coalesce(s.size, 0) < m.peso * (SELECT sum(size) FROM s)"""
)
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    short = _mix(spark, sf).report.where("short").select(F.col("source").alias("name"))
    wanted = table(spark, sf, "mezcla_objetivo").select("source")
    return wanted.join(short, F.lower(F.trim("source")) == F.col("name"), "left_semi")


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every use of a document in the mix."""
    return _mix(spark, sf).rows


@query
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and reached tokens and shares of each source."""
    return _mix(spark, sf).report


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    return cut_records(table(spark, sf, "documents"), "doc_id", "text", "source", "n_chars")


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf).where("cut").select("doc_id")


@query
def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its probability of having lost its end."""
    return _cuts(spark, sf)


@query
def p9_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source truncates, and its length limits."""
    return source_rates(_cuts(spark, sf))
