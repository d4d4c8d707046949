"""Profiles of tables and gates that they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, fields: list[str], accuracy: int = 10_000) -> DataFrame:
    """One row per numeric field: count, nulls, null share, min, max, mean, stddev, approximate distinct values and quartiles.

    The fields are unpivoted and aggregated together: one pass, no wide aggregate.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    q = F.percentile_approx("x", [0.25, 0.5, 0.75], accuracy)
    a = df.select(F.explode(parts).alias("v")).select("v.*").groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.approx_count_distinct("x").alias("approx_unique"), q.alias("q"),
    )
    return a.select("field", "rows", "count", (F.col("rows") - F.col("count")).alias("nulls"), ((F.col("rows") - F.col("count")) / F.col("rows")).alias("null_share"), "min", "max", "mean", "std", "approx_unique", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def profile_strings(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per string field: rows, count, nulls, blanks, shortest and longest, first and last in order, approximate distinct values."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("x")) for f in fields])
    a = df.select(F.explode(parts).alias("v")).select("v.*").groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("count"), F.sum((F.trim("x") == "").cast("long")).alias("blanks"), F.min(F.length("x")).alias("shortest"), F.max(F.length("x")).alias("longest"),
        F.min("x").alias("first"), F.max("x").alias("last"), F.approx_count_distinct("x").alias("approx_unique"),
    )
    return a.select("field", "rows", "count", (F.col("rows") - F.col("count")).alias("nulls"), F.coalesce("blanks", F.lit(0)).alias("blanks"), "shortest", "longest", "first", "last", "approx_unique")


def null_shares(df: DataFrame, group: str | None, fields: list[str]) -> DataFrame:
    """``[group], field, null_pct, zero_pct``: shares in percent of null and of zero values."""
    g = [group] if group else []
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().cast("int").alias("isnull"), F.coalesce(F.col(f).cast("double") == 0, F.lit(False)).cast("int").alias("zero")) for f in fields])
    long = df.select(*g, F.explode(parts).alias("v")).select(*g, "v.*")
    return long.groupBy(*g, "field").agg((F.avg("isnull") * 100).alias("null_pct"), (F.avg("zero") * 100).alias("zero_pct"))


def share_shift(df: DataFrame, group: str, fields: list[str], base, now) -> DataFrame:
    """``field`` with the null and zero shares of two groups and their absolute differences."""
    s = null_shares(df.where(F.col(group).isin(base, now)), group, fields)
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    w = s.groupBy("field").agg(pick(base, "null_pct").alias("null_base"), pick(now, "null_pct").alias("null_now"), pick(base, "zero_pct").alias("zero_base"), pick(now, "zero_pct").alias("zero_now"))
    return w.select("*", F.abs(F.col("null_now") - F.col("null_base")).alias("null_shift"), F.abs(F.col("zero_now") - F.col("zero_base")).alias("zero_shift"))


def gates(df: DataFrame, key: list[str], target: str, domain: list[str], amounts: list[str]) -> DataFrame:
    """``gate, violations``: null keys, repeated keys, targets outside the domain, infinite amounts; one aggregate each, no row leaves."""
    spark = df.sparkSession
    keyed = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    any_null = F.lit(False)
    for k in key:
        any_null = any_null | F.col(k).isNull()
    k = keyed.agg(F.sum(F.when(any_null, F.col("n")).otherwise(0)).alias("null_keys"), F.sum(F.col("n") - 1).alias("repeated_keys"))
    outside = F.col(target).isNotNull() & ~F.col(target).isin(domain)
    inf = F.lit(0)
    for a in amounts:
        inf = inf + F.coalesce(F.abs(F.col(a).cast("double")) == F.lit(float("inf")), F.lit(False)).cast("int")
    t = df.agg(F.sum(outside.cast("int")).alias("outside_domain"), F.sum(inf).alias("infinite_amounts"), F.count(F.lit(1)).alias("rows"))
    one = k.crossJoin(F.broadcast(t))  # one row each
    names = ["null_keys", "repeated_keys", "outside_domain", "infinite_amounts"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("violations")) for n in names])).alias("g")).select("g.*")


def target_gates(df: DataFrame, period: str, target: str, positive: str, least_rows: int, lowest: float, highest: float) -> DataFrame:
    """``period, rows, rate, few_rows, odd_target``: periods with fewer rows than wanted, and labelled periods whose rate of ``positive`` is out of bounds."""
    g = df.groupBy(period).agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(target) == positive).cast("double")).alias("rate"))
    return g.select(period, "rows", "rate", (F.col("rows") < least_rows).alias("few_rows"), F.coalesce(~F.col("rate").between(lowest, highest), F.lit(False)).alias("odd_target"))


def require_columns(df: DataFrame, types: dict[str, str]) -> None:
    """Raise unless every column is there with its type."""
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in types.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"columns with wrong types (wanted, found): {wrong}")


def require_periods(df: DataFrame, period: str, wanted: list[int]) -> None:
    """Raise if a wanted period has no rows."""
    have = {r[0] for r in df.where(F.col(period).isin(wanted)).select(period).distinct().collect()}
    if missing := [p for p in wanted if p not in have]:
        raise ValueError(f"periods without rows: {missing}")


def same_summary(a: DataFrame, b: DataFrame) -> bool:
    """Do two summaries hold the same rows with the same counts?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
