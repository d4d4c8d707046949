"""Positions and running sums inside groups of any size, without one task per group.

A window over a group with a third of all rows would sort that third in one
task.  Here every group is cut into as many slices of its ordering key as its
size asks for; slices are sorted on their own and shifted by the totals of the
slices before them.  The key must be uniform in [0, 1) (a hash), which is what
makes the slices even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.staging import stage


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the hash of ``cols``."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def running_in_groups(df: DataFrame, groups: list[str], key: str, ties: list[str], value: str | None = None, slice_rows: int = 50_000) -> DataFrame:
    """``df`` with ``pos`` (1-based place in its group by ``key`` and ``ties``), ``n`` (rows of the group) and, with ``value``, ``cum`` and ``total``.

    ``df`` must have no columns named pos, n, cum, total or slice, and is read
    three times: stage it if it is costly.  The tables joined back hold one row
    per group and per slice; they are broadcast only when counted and small,
    else Spark shuffles (and, where a group is hot, splits) the join.
    """
    measure = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    sizes = _small(df.groupBy(*groups).agg(*measure))
    cut = _join(df, sizes, groups).withColumn("slice", F.floor(F.col(key) * F.ceil(F.col("n") / slice_rows)).cast("long"))
    part = cut.groupBy(*groups, "slice").agg(F.count(F.lit(1)).alias("_n"), *([F.sum(value).alias("_v")] if value else []))
    before = Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = _small(part.select(*groups, "slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *([F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v")] if value else [])))
    inside = Window.partitionBy(*groups, "slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = _join(cut, shift, [*groups, "slice"]).withColumns(
        {"pos": F.row_number().over(Window.partitionBy(*groups, "slice").orderBy(key, *ties)) + F.col("_n")} | ({"cum": F.sum(value).over(inside) + F.col("_v")} if value else {})
    )
    return out.drop("slice", "_n", "_v")


BROADCAST_ROWS = 50_000


def _small(df: DataFrame) -> DataFrame:
    """A staged copy, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    copy = stage(df, "small")
    return F.broadcast(copy) if copy.count() <= BROADCAST_ROWS else copy


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with the one row of ``right`` that has equal (or equally null) keys."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        one = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond, "inner").drop(*[f"__r_{c}" for c in on])


def running_by_order(df: DataFrame, groups: list[str], order: list[Column], values: list[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``pos`` (1-based place in its group by ``order``) and ``cum_<v>`` (running sum of each of ``values``).

    For keys that are not uniform: the rows are range-partitioned by group and
    order and staged with their partition number; partitions are ranked on
    their own and shifted by the totals of the partitions before them.  No
    group, nor the whole table where ``groups`` is empty, is sorted in one task.
    ``order`` should be total, else equal rows come in either order.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in groups]
    cut = stage(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    part = cut.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"__s_{v}") for v in values])
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = _small(part.select(*groups, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__s_{v}") for v in values]))
    w = Window.partitionBy(*groups, "__part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = _join(cut, shift, [*groups, "__part"]).withColumns({"pos": F.row_number().over(w) + F.col("__n")} | {f"cum_{v}": F.sum(v).over(run) + F.col(f"__s_{v}") for v in values})
    return out.drop("__part", "__n", *[f"__s_{v}" for v in values])


def value_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups, value, below, same, n`` for every distinct non-null value of each group.

    All tie-stable ranks follow: percent_rank = below / (n - 1), cume_dist =
    (below + same) / n, average rank = below + (same + 1) / 2.  Equal values
    are counted map-side, so only distinct values are ordered.
    """
    per = stage(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("same")), "values")  # read three times
    run = running_by_order(per, groups, [F.col(value).asc()], ["same"])
    n = _small(per.groupBy(*groups).agg(F.sum("same").alias("n")))
    out = run.select(*groups, value, (F.col("cum_same") - F.col("same")).alias("below"), "same")
    return _join(out, n, groups) if groups else out.crossJoin(F.broadcast(n))  # n is one row


def quantiles(df: DataFrame, groups: list[str], value: str, ps: list[float], accuracy: int | None = 10_000) -> DataFrame:
    """``groups, q``: the values at the shares ``ps`` of the non-null values of each group; no row for a group without values.

    With ``accuracy`` from summaries that are merged map-side, each value being
    a true one whose rank is off by at most 1 / accuracy of the group.  Without,
    exactly, between two places interpolated: distinct values are counted
    map-side and ordered over all tasks, so no group is ordered in one.
    """
    if accuracy:
        return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.percentile_approx(value, list(ps), accuracy).alias("q"))
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("same")), F.col(value).cast("double")))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in ps]
    r = value_ranks(df, groups, value).groupBy(*groups).agg(F.max("n").alias("n"), *[at(F.floor(k)).alias(f"lo{i}") for i, k in enumerate(places)], *[at(F.ceil(k)).alias(f"hi{i}") for i, k in enumerate(places)])
    part = [k - F.floor(k) for k in places]
    return r.where("n is not null").select(*groups, F.array(*[F.col(f"lo{i}") + part[i] * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(len(ps))]).alias("q"))


def with_ranks(df: DataFrame, groups: list[str], value: str, prefix: str = "") -> DataFrame:
    """``df`` with ``<prefix>below, <prefix>same, <prefix>n`` of ``value``; null values get nulls."""
    r = value_ranks(df, groups, value)
    r = r.select(*[F.col(c).alias(f"__k_{c}") for c in (*groups, value)], *[F.col(c).alias(f"{prefix}{c}") for c in ("below", "same", "n")])
    cond = F.col(value) == F.col(f"__k_{value}")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    return df.join(r, cond, "left").drop(*[f"__k_{c}" for c in (*groups, value)])
