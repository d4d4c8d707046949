"""How far a distribution moved between two populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.operators.ranking import quantiles
from cohortex.staging import stage

EPSILON = 1e-10


def _binned(df: DataFrame, group: str, base, now, fields: list[str], buckets: int, accuracy: int | None, keep: list[Column] = []) -> DataFrame:
    """``field, is_base, bin`` and ``keep`` of both populations' rows: bins [a, b) over the union's quantiles, the last one closed; nulls are bin -1.

    All fields are unpivoted and their edges found in one aggregate; the edges,
    one row a field, are sent to the tasks.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    two = df.where(F.col(group).isin(base, now)).select((F.col(group) == base).alias("is_base"), *keep, F.explode(parts).alias("v")).select("*", "v.*").drop("v")
    two = two if accuracy else stage(two, "binned")
    q = quantiles(two, ["field"], "x", [i / buckets for i in range(buckets + 1)], accuracy)
    edges = q.select(F.col("field").alias("e_field"), F.array_sort(F.array_distinct("q")).alias("e"))
    x, e = F.col("x"), F.col("e")
    bin_ = F.when(x.isNull(), F.lit(-1)).when(F.size(e) < 2, F.lit(0)).when(x >= F.element_at(e, -1), F.size(e) - 2).otherwise(F.size(F.filter(e, lambda at: at <= x)) - 1)
    return two.join(F.broadcast(edges), F.col("field") == F.col("e_field"), "left").withColumn("bin", bin_).drop("e_field", "e", "x")


def psi_tables(df: DataFrame, group: str, base, now, fields: list[str], buckets: int = 10, accuracy: int | None = 10_000) -> DataFrame:
    """``field, bin, expected, actual, expected_prop, actual_prop, term``: bins [a, b), the last closed, over the union's quantiles, and a bin (-1) of nulls.

    Shares of value bins are over non-null rows, those of the null bin over all
    rows.  accuracy: as in ``quantiles``.  One scan for all fields.
    """
    d = _binned(df, group, base, now, fields, buckets, accuracy)
    per = d.groupBy("field", "bin").agg(F.sum(F.col("is_base").cast("long")).alias("expected"), F.sum((~F.col("is_base")).cast("long")).alias("actual"))
    of = Window.partitionBy("field")  # a handful of bins
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.when(F.col("bin") < 0, F.sum(n).over(of)).otherwise(F.sum(F.when(F.col("bin") >= 0, F.col(n))).over(of)).cast("double")), F.lit(0.0))
    j = per.select("field", "bin", "expected", "actual", share("expected").alias("expected_prop"), share("actual").alias("actual_prop"))
    e, a = F.greatest("expected_prop", F.lit(EPSILON)), F.greatest("actual_prop", F.lit(EPSILON))
    return j.withColumn("term", (F.col("actual_prop") - F.col("expected_prop")) * F.log(a / e))


def psi_table(df: DataFrame, group: str, base, now, field: str, buckets: int = 10, accuracy: int | None = 10_000) -> DataFrame:
    """``psi_tables`` of one field, without its name."""
    return psi_tables(df, group, base, now, [field], buckets, accuracy).drop("field")


def psi(df: DataFrame, group: str, base, now, fields: list[str], buckets: int = 10, accuracy: int | None = 10_000) -> DataFrame:
    """``field, psi`` for each field."""
    return psi_tables(df, group, base, now, fields, buckets, accuracy).groupBy("field").agg(F.sum("term").alias("psi"))


def target_by_bins(df: DataFrame, group: str, base, now, fields: list[str], positive: str, buckets: int = 10, accuracy: int | None = 10_000) -> DataFrame:
    """``field, bin, base_rate, now_rate, shift``: the rate of positives in each bin for both populations."""
    d = _binned(df, group, base, now, fields, buckets, accuracy, [F.col(positive).cast("int").alias("y")])
    r = d.groupBy("field", "bin").agg(F.avg(F.when(F.col("is_base"), F.col("y"))).alias("base_rate"), F.avg(F.when(~F.col("is_base"), F.col("y"))).alias("now_rate"))
    return r.withColumn("shift", F.col("now_rate") - F.col("base_rate"))


def target_by_bin(df: DataFrame, group: str, base, now, field: str, positive: str, buckets: int = 10, accuracy: int | None = 10_000) -> DataFrame:
    return target_by_bins(df, group, base, now, [field], positive, buckets, accuracy).drop("field")


def ks(df: DataFrame, value: str, is_first: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance: ``ks, n1, n2``, from running counts over distinct values."""
    from cohortex.operators.ranking import running_by_order

    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(F.col(is_first).cast("long")).alias("a"), F.sum((~F.col(is_first)).cast("long")).alias("b"))
    tot = per.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    r = running_by_order(per, [], [F.col(value).asc()], ["a", "b"]).crossJoin(F.broadcast(tot))  # one row
    return r.agg(F.max(F.abs(F.col("cum_a") / F.col("n1") - F.col("cum_b") / F.col("n2"))).alias("ks"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
