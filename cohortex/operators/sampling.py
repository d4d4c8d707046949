"""Deterministic samples and stratified partitions by hashes, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.functions.exprs import splitmix64_uniform
from cohortex.operators.ranking import running_by_order, running_in_groups, uniform


def undersample(df: DataFrame, entity: str, period: str, keep: Column, rate: float, seed: int) -> DataFrame:
    """All rows where ``keep`` holds, and of the others those whose splitmix64 number is at most ``rate``."""
    return df.where(F.coalesce(keep, F.lit(False)) | (splitmix64_uniform(entity, period, seed) <= rate))


def expected_rows(df: DataFrame, keep: Column, rate: float) -> DataFrame:
    """Rows that ``undersample`` leaves, on average, without drawing them."""
    k = F.coalesce(keep, F.lit(False))
    return df.agg(F.sum(k.cast("long")).alias("kept"), F.sum((~k).cast("long")).alias("others")).select("kept", "others", F.round(F.col("kept") + F.col("others") * rate).cast("long").alias("expected"))


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) in hash order; one top-n pass."""
    return df.orderBy(uniform(*keys, seed=seed), *keys).limit(n)


def sample_with_minority(df: DataFrame, keys: list[str], minority: Column, n: int, seed: int) -> DataFrame:
    """All minority rows and ``n`` of the others."""
    m = F.coalesce(minority, F.lit(False))
    return df.where(m).unionByName(sample_n(df.where(~m), keys, n, seed))


def stratified_blocks(df: DataFrame, stratum: list[str], keys: list[str], parts: list[int], seed: int) -> DataFrame:
    """``df`` with ``block`` 1..len(parts): within each stratum, rows in hash order are dealt in the ratio ``parts``, exactly."""
    total, edges, at = sum(parts), [], 0
    for p in parts:
        at += p
        edges.append(at)
    r = running_in_groups(df.withColumn("__u", uniform(*keys, seed=seed)), stratum, "__u", keys)
    place = (F.col("pos") - 1) % total
    block = F.coalesce(*[F.when(place < e, F.lit(i + 1)) for i, e in enumerate(edges)])
    return r.withColumn("block", block.cast("int")).drop("__u", "pos", "n")


def repeated_splits(df: DataFrame, stratum: list[str], keys: list[str], share: float, repetitions: int, seed: int) -> DataFrame:
    """``df`` once per repetition with ``repetition`` and ``part`` (1: the share, rounded half to even, of every stratum; 2: the rest), each repetition by a hash order of its own."""
    many = df.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("__u", uniform(*keys, "repetition", seed=seed))
    r = running_in_groups(many, ["repetition", *stratum], "__u", keys)
    return r.withColumn("part", F.when(F.col("pos") <= F.bround(F.col("n") * F.lit(float(share)), 0), 1).otherwise(2)).drop("__u", "pos", "n")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each map task to n rows a group before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= n)


def loyal_match(df: DataFrame, entity: str, target: str, left: Column, seed: int) -> DataFrame:
    """``entity, cohort``: all entities that left, and as many that never did, in hash order."""
    per = df.groupBy(entity).agg(F.max(F.coalesce(left, F.lit(False)).cast("int")).alias("left"))
    gone = per.where("left = 1").select(entity, F.lit("churn").alias("cohort"))
    n = gone.count()
    stay = running_by_order(per.where("left = 0").withColumn("__u", uniform(entity, seed=seed)), [], [F.col("__u").asc(), F.col(entity).asc()])
    return gone.unionByName(stay.where(F.col("pos") <= n).select(entity, F.lit("leal").alias("cohort")))
