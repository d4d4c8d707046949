"""Comparisons of groups of entities: effect sizes, lifts, trends and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions.periods import month_index
from cohortex.operators.ranking import _join, quantiles
from cohortex.staging import stage


def _long(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    return df.select(*keep, F.explode(parts).alias("v")).select(*keep, "v.*")


def cohens_d(df: DataFrame, group: str, a, b, fields: list[str]) -> DataFrame:
    """``field, d, magnitude``: mean difference (a - b) over the root of the mean sample variance; small below .5, large from .8."""
    s = _long(df.where(F.col(group).isin(a, b)), [group], fields).groupBy("field").agg(
        *[f(F.when(F.col(group) == g, F.col("x"))).alias(f"{n}{k}") for g, k in ((a, "a"), (b, "b")) for f, n in ((F.avg, "m"), (F.var_samp, "v"))]
    )
    d = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt((F.col("va") + F.col("vb")) / 2))
    size = F.abs("d")
    return s.select("field", d.alias("d")).withColumn("magnitude", F.when(size >= 0.8, "grande").when(size >= 0.5, "mediano").when(size.isNotNull(), "chico"))


def lifts(df: DataFrame, group: str, fields: list[str], accuracy: int | None = 10_000, higher: bool = True) -> DataFrame:
    """``group, field, lift``: share of a group's values above (or below) the population's median, over a half; accuracy: as in ``quantiles``."""
    long = _long(df, [group], fields).where("x is not null")
    m = quantiles(long, ["field"], "x", [0.5], accuracy).select("field", F.col("q")[0].alias("m"))
    beyond = F.col("x") > F.col("m") if higher else F.col("x") < F.col("m")
    return long.join(F.broadcast(m), "field").groupBy(group, "field").agg((F.avg(beyond.cast("double")) / 0.5).alias("lift"))  # one row a field


def profile_lifts(df: DataFrame, group: str, binary: list[str], higher: list[str], lower: list[str], accuracy: int | None = 10_000) -> DataFrame:
    """``group, field, lift`` of fields of every kind: the mean over the population's for ``binary`` ones, ``lifts`` above or below the median for the others."""
    long = _long(df, [group], binary).where("x is not null")
    all_ = long.groupBy("field").agg(F.avg("x").alias("base"))
    out = long.groupBy(group, "field").agg(F.avg("x").alias("rate")).join(F.broadcast(all_), "field").select(group, "field", F.try_divide(F.col("rate"), F.col("base")).alias("lift"))  # one row a field
    for fields, up in ((higher, True), (lower, False)):
        out = out.unionByName(lifts(df, group, fields, accuracy, up)) if fields else out
    return out


def rule_lifts(df: DataFrame, rules: dict[str, str], positive: str, least: int = 30) -> DataFrame:
    """``alert_rules`` with at least ``least`` rows and their ``odds``: the rate where a rule holds over the rate where it does not."""
    r = alert_rules(df, rules, positive)
    tot = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(positive).cast("int")).alias("pos"))
    j = r.where(F.col("n") >= least).crossJoin(F.broadcast(tot))  # one row
    return j.withColumn("odds", F.try_divide(F.col("precision"), (F.col("pos") - F.col("hits")) / (F.col("rows") - F.col("n")))).drop("rows", "pos")


def risk_score(df: DataFrame, key: list[str], rules: dict[str, tuple[str, int]], levels: list[tuple[int, str]]) -> DataFrame:
    """``key, score, level``: points of the rules (SQL condition, points) that hold, and the name of the highest level whose points are reached."""
    total = F.lit(0)
    for condition, points in rules.values():
        total = total + F.when(F.expr(condition), points).otherwise(0)
    level = F.lit(None).cast("string")
    for points, name in sorted(levels):
        level = F.when(F.col("score") >= points, name).otherwise(level)
    return df.withColumn("score", total.cast("int")).withColumn("level", level).select(*key, "score", "level")


def anchor_products(df: DataFrame, products: list[str], positive: str) -> DataFrame:
    """``product, holders, others, rate_holders, rate_others, ratio``: the rate of positives with and without each product (a count above 0)."""
    has = _long(df, [positive], products).select("field", F.coalesce(F.col("x") > 0, F.lit(False)).alias("has"), F.col(positive).cast("double").alias("y"))
    g = has.groupBy(F.col("field").alias("product")).agg(
        F.sum(F.col("has").cast("long")).alias("holders"), F.sum((~F.col("has")).cast("long")).alias("others"), F.avg(F.when(F.col("has"), F.col("y"))).alias("rate_holders"), F.avg(F.when(~F.col("has"), F.col("y"))).alias("rate_others")
    )
    return g.withColumn("ratio", F.try_divide(F.col("rate_holders"), F.col("rate_others")))


def offer_sizes(df: DataFrame, segment: str, offers: dict[str, str], value: str) -> DataFrame:
    """``segment, offer, rows, value``: how many rows of each segment lack what an offer sells (SQL condition), and what they are worth."""
    parts = F.array(*[F.struct(F.lit(n).alias("offer"), F.coalesce(F.expr(c), F.lit(False)).alias("fits")) for n, c in offers.items()])
    long = df.select(segment, value, F.explode(parts).alias("v")).select(segment, value, "v.*").where("fits")
    return long.groupBy(segment, "offer").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("value"))


def cohort_profit(df: DataFrame, cohort: str, entity: str, period: str, amount: str, loyal: Column, skip: int = 2) -> DataFrame:
    """``cohort, entities, monthly, yearly, total, ratio, category``: what an amount brings per cohort without each entity's last ``skip`` periods, against the loyal rows of ``df``.

    Cohorts are the rows where ``loyal`` is not true.  ratio: yearly mean over
    that of the loyal; categories end at .5, 1 and 1.5 (right-closed).
    """
    kept = skip_last_periods(df.where(~F.coalesce(loyal, F.lit(False))), entity, period, skip)
    g = kept.groupBy(cohort).agg(F.countDistinct(entity).alias("entities"), F.avg(amount).alias("monthly"))
    base = df.where(loyal).agg((F.avg(amount) * 12).alias("base"))
    j = g.crossJoin(F.broadcast(base)).withColumn("yearly", F.col("monthly") * 12)  # one row
    j = j.select(cohort, "entities", "monthly", "yearly", (F.col("yearly") * F.col("entities")).alias("total"), F.try_divide(F.col("yearly"), F.col("base")).alias("ratio"))
    r = F.col("ratio")
    return j.withColumn("category", F.when(r <= 0.5, "Bajo valor").when(r <= 1.0, "Medio-bajo").when(r <= 1.5, "Medio-alto").when(r.isNotNull(), "Alto valor"))


def binary_lift(df: DataFrame, group: str, condition: Column) -> DataFrame:
    """``group, n, rate, lift``: the rate of a condition in each group over that of all rows."""
    c = F.coalesce(condition, F.lit(False)).cast("double")
    all_ = df.agg(F.avg(c).alias("base"))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("rate")).crossJoin(F.broadcast(all_)).select(group, "n", "rate", F.try_divide(F.col("rate"), F.col("base")).alias("lift"))  # one row


def alert_rules(df: DataFrame, rules: dict[str, str], positive: str) -> DataFrame:
    """``rule, n, hits, recall, precision, lift`` of SQL conditions against the positives; one pass for all rules."""
    y = F.col(positive).cast("int")
    d = df.select(y.alias("y"), *[F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"r{i}") for i, c in enumerate(rules.values())])
    aggs = [F.sum("y").alias("pos"), F.count(F.lit(1)).alias("rows")]
    for i in range(len(rules)):
        aggs += [F.sum(f"r{i}").alias(f"n{i}"), F.sum(F.col(f"r{i}") * F.col("y")).alias(f"h{i}")]
    parts = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("hits")) for i, n in enumerate(rules)])
    one = d.agg(*aggs).select("pos", "rows", F.explode(parts).alias("v")).select("pos", "rows", "v.*")
    precision = F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double"))
    return one.select("rule", "n", "hits", F.try_divide(F.col("hits").cast("double"), F.col("pos").cast("double")).alias("recall"), precision.alias("precision"), F.try_divide(precision, F.col("pos") / F.col("rows")).alias("lift"))


def decile_rates(ranked: DataFrame, decile: str, positive: str) -> DataFrame:
    """``decile, n, rate, lift`` of positives."""
    return binary_lift(ranked.where(F.col(decile).isNotNull()), decile, F.col(positive))


def relative_period(df: DataFrame, entity: str, period: str) -> DataFrame:
    """``df`` with ``rel``: periods to the first one after the entity's last (every row is at -1 or earlier)."""
    i = month_index(period)
    return df.withColumn("rel", i - (F.max(i).over(Window.partitionBy(entity)) + 1))


def trends(df: DataFrame, by: list[str], field: str, band: str = "ic95", accuracy: int | None = 10_000) -> DataFrame:
    """``by, n, centre, low, high``: mean and band (``ic95``, ``desvio`` or, around the median, ``iqr``), clipped to the observed range; accuracy: as in ``quantiles``."""
    known = df.where(F.col(field).isNotNull())
    if band == "iqr":
        d = known.select(*by, field) if accuracy else stage(known.select(*by, field), "trend")
        q, n = quantiles(d, by, field, [0.25, 0.5, 0.75], accuracy), d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return _join(n, q, by).select(*by, "n", F.col("q")[1].alias("centre"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"))
    g = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(field).alias("mean"), F.stddev_samp(field).alias("sd"), F.min(field).alias("lo"), F.max(field).alias("hi"))
    half = F.coalesce(1.96 * F.col("sd") / F.sqrt("n") if band == "ic95" else F.col("sd"), F.lit(0.0))
    return g.select(*by, "n", F.col("mean").alias("centre"), F.greatest(F.col("mean") - half, "lo").alias("low"), F.least(F.col("mean") + half, "hi").alias("high"))


def early_warning(df: DataFrame, entity: str, period: str, fields: list[str], least: int = 30) -> DataFrame:
    """``field, n, change``: mean change from three to one periods before the end, in standard deviations of the field at three before."""
    r = relative_period(df, entity, period).where(F.col("rel").isin(-3, -1))
    w = _long(r, [entity, "rel"], fields).groupBy(entity, "field").agg(F.max(F.when(F.col("rel") == -3, F.col("x"))).alias("far"), F.max(F.when(F.col("rel") == -1, F.col("x"))).alias("near"))
    s = w.where("far is not null and near is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("near") - F.col("far")).alias("d"), F.stddev_samp("far").alias("sd"))
    return s.where(F.col("n") >= least).select("field", "n", F.try_divide(F.col("d"), F.col("sd")).alias("change"))


def group_mix(df: DataFrame, period: str, group: str) -> DataFrame:
    """``period, group, n, share``: make-up of every period."""
    c = df.groupBy(period, group).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))  # one row per period and group


def box(df: DataFrame, group: str, field: str, accuracy: int | None = 10_000) -> DataFrame:
    """``group, min, q1, median, q3, max``; accuracy: as in ``quantiles``."""
    g = quantiles(df.select(group, F.col(field).cast("double").alias(field)), [group], field, [0.0, 0.25, 0.5, 0.75, 1.0], accuracy)
    return g.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def histogram(df: DataFrame, field: str, bins: int = 30, lo: float = 0.01, hi: float = 0.99, accuracy: int | None = 10_000) -> DataFrame:
    """``bin, n``: equal bins between two percentiles, the last one closed; values outside are left out; accuracy: as in ``quantiles``."""
    x = F.col(field).cast("double")
    q = quantiles(df.select(x.alias("x")), [], "x", [lo, hi], accuracy).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    d = df.select(x.alias("x")).crossJoin(F.broadcast(q)).where(F.col("x").between(F.col("a"), F.col("b")))  # one row
    k = F.least(F.floor(F.try_divide(F.col("x") - F.col("a"), (F.col("b") - F.col("a"))) * bins), F.lit(bins - 1))
    return d.select(F.coalesce(k, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def population_percentile(df: DataFrame, field: str, values: list[float]) -> DataFrame:
    """``value, pct``: share of rows at or below each value, in percent; 50 for an empty population."""
    aggs = [F.avg((F.col(field) <= v).cast("double")).alias(f"v{i}") for i, v in enumerate(values)]
    parts = F.array(*[F.struct(F.lit(float(v)).alias("value"), F.coalesce(F.col(f"v{i}") * 100, F.lit(50.0)).alias("pct")) for i, v in enumerate(values)])
    return df.agg(*aggs).select(F.explode(parts).alias("v")).select("v.*")


def segment_errors(df: DataFrame, segment: str, positive: str, sent: str, value: str) -> DataFrame:
    """``segment, n, recall, precision, missed_value``: what a list of sent entities catches per segment, and the value of positives it misses."""
    y, s = F.coalesce(F.col(positive), F.lit(False)), F.coalesce(F.col(sent), F.lit(False))
    hit = (y & s).cast("double")
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(hit), F.sum(y.cast("double"))).alias("recall"), F.try_divide(F.sum(hit), F.sum(s.cast("double"))).alias("precision"),
        F.sum(F.when(y & ~s, F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.lit(0.0))).alias("missed_value"),
    )


def skip_last_periods(df: DataFrame, entity: str, period: str, skip: int) -> DataFrame:
    """Rows without each entity's last ``skip`` periods."""
    r = F.dense_rank().over(Window.partitionBy(entity).orderBy(F.col(period).desc()))
    return df.withColumn("__r", r).where(F.col("__r") > skip).drop("__r")
