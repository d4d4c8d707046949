"""Rank and contingency statistics from distributed ranks and counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.operators.ranking import with_ranks


def mann_whitney(df: DataFrame, value: str, is_first: str) -> DataFrame:
    """``u, z, n1, n2``: U of the first sample with average ranks, and its normal score corrected for ties."""
    d = df.where(F.col(value).isNotNull() & F.col(is_first).isNotNull())
    r = with_ranks(d, [], value, "__")
    s = r.agg(
        F.sum(F.when(F.col(is_first), F.col("__below") + (F.col("__same") + 1) / 2)).alias("ranks"), F.sum(F.col(is_first).cast("double")).alias("n1"), F.sum((~F.col(is_first)).cast("double")).alias("n2"),
        F.sum((F.col("__same").cast("double") * F.col("__same") - 1)).alias("ties"),
    )
    u = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    return s.select(u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n2") / 2, F.sqrt(var)).alias("z"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"))


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2))


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    """``df`` (one row a test) with ``p``, the two-sided p-value of its normal score: Simpson's rule over the density, off by less than 1e-9."""
    steps, far = 2000, 8.0
    x = F.least(F.abs(z), F.lit(far))
    h = x / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) * F.exp(-F.pow(i * h, F.lit(2.0)) / 2))
    return df.withColumn("p", F.greatest(F.lit(0.0), 1 - 2 * area * h / 3 / math.sqrt(2 * math.pi)))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """``chi2, df, n`` of the contingency table of two columns, rows with a null left out."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, rb = c.groupBy(a).agg(F.sum("o").alias("na")), c.groupBy(b).agg(F.sum("o").alias("nb"))
    n = c.agg(F.sum("o").alias("n"))
    seen = c.join(ra, a).join(rb, b).crossJoin(F.broadcast(n))  # one row
    part = seen.agg(F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb") / F.col("n"))).alias("s"), F.max("n").alias("n"))
    shape = ra.agg(F.count(F.lit(1)).alias("r")).crossJoin(rb.agg(F.count(F.lit(1)).alias("k")))  # one row each
    return part.crossJoin(shape).select((F.col("s") - F.col("n")).alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).cast("long").alias("df"), F.col("n").cast("long").alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rho, n``: correlation of average ranks over rows with both values."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = with_ranks(with_ranks(d, [], a, "__a"), [], b, "__b")
    x, y = F.col("__abelow") + (F.col("__asame") + 1) / 2, F.col("__bbelow") + (F.col("__bsame") + 1) / 2
    return r.agg(F.corr(x, y).alias("rho"), F.count(F.lit(1)).alias("n"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """``w_plus, w_minus, z, n`` of paired differences a - b, zeros left out, ties averaged (no tie correction of z)."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    r = with_ranks(d, [], "size", "__")
    rank = F.col("__below") + (F.col("__same") + 1) / 2
    s = r.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, rank)), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, rank)), F.lit(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return s.select("w_plus", "w_minus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"), "n")


def spearman_matrix(df: DataFrame, fields: list[str], key: list[str], group: str | None = None) -> DataFrame:
    """``a, b, rho, n`` for every two fields, a before b in ``fields``: correlation of average ranks, ranks taken over each field's own values."""
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for i, f in enumerate(fields)])).alias("v")).select(*key, "v.*")
    r = with_ranks(long, ["field"], "x", "__")
    wide = r.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.col("__below") + (F.col("__same") + 1) / 2)).alias(f"r{i}") for i, f in enumerate(fields)])
    two = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    both = lambda i, j: F.col(f"r{i}").isNotNull() & F.col(f"r{j}").isNotNull()
    one = wide.agg(*[F.struct(F.lit(fields[i]).alias("a"), F.lit(fields[j]).alias("b"), F.corr(F.when(both(i, j), F.col(f"r{i}")), F.when(both(i, j), F.col(f"r{j}"))).alias("rho"), F.sum(both(i, j).cast("long")).alias("n")).alias(f"p{k}") for k, (i, j) in enumerate(two)])
    return one.select(F.explode(F.array(*[F.col(f"p{k}") for k in range(len(two))])).alias("v")).select("v.*")


def density(df: DataFrame, value: str, points: list[float], bandwidth: float) -> DataFrame:
    """``point, density``: a Gaussian kernel estimate at the given points, one aggregate over the values."""
    x = F.col(value).cast("double")
    one = lambda at: F.avg(F.exp(-F.pow((x - F.lit(float(at))) / bandwidth, F.lit(2.0)) / 2) / (bandwidth * math.sqrt(2 * math.pi)))
    a = df.where(x.isNotNull()).agg(*[one(p).alias(f"d{i}") for i, p in enumerate(points)])
    return a.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(f"d{i}").alias("density")) for i, p in enumerate(points)])).alias("v")).select("v.*")


def sequential_wilcoxon(rounds: list[DataFrame], a: str, b: str, level: float = 0.05) -> tuple[int, float]:
    """Paired rounds are added one by one until their differences are significant: the number of rounds used and the last p-value.  Each round is one table of ``a`` and ``b``."""
    seen, p = None, 1.0
    for k, r in enumerate(rounds, start=1):
        seen = r.select(a, b) if seen is None else seen.unionByName(r.select(a, b))
        z = wilcoxon(seen, a, b).first()["z"]
        p = normal_p(z) if z is not None else 1.0
        if p < level:
            return k, p
    return len(rounds), p
