"""Comparing variants, trials and features over seeds and simulated splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortex.operators.ranking import running_in_groups, uniform
from cohortex.staging import stage


def trial_stability(values: DataFrame, trial: str, value: str, how: str = "median", penalty: float = 1.0) -> DataFrame:
    """``trial, n, mean, median, std, min, max, score, optimism, chosen``: population deviation over seeds; the best score wins, ties to the lowest trial.

    optimism: how far the trial's best seed is above its median, what choosing by a single seed may promise too much.
    """
    s = values.groupBy(trial).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    score = F.col("median") if how == "median" else F.col("mean") - penalty * F.col("std")
    s = s.withColumns({"score": score, "optimism": F.col("max") - F.col("median")})
    best = s.agg(F.max(F.struct(F.col("score"), (-F.col(trial)).alias("t"))).alias("b")).select((-F.col("b.t")).alias("__best"))
    return s.crossJoin(F.broadcast(best)).withColumn("chosen", F.col(trial) == F.col("__best")).drop("__best")  # one row


def paired_comparison(values: DataFrame, variant: str, reference: str, seed: str, fold: str, value: str) -> DataFrame:
    """``variant, mean, delta, error, better_seeds, verdict`` against the reference, paired by seed.

    values: one row per variant, seed and fold.  error: the standard error of
    the per-seed mean differences.  Verdict: ``indistinguible`` if |delta| is
    at most two errors, ``mejor`` or ``peor`` if all folds agree, else ``mixto``.
    """
    ref = values.where(F.col(variant) == reference).select(F.col(seed).alias("__s"), F.col(fold).alias("__f"), F.col(value).alias("__ref"))
    d = values.join(ref, (F.col(seed) == F.col("__s")) & (F.col(fold) == F.col("__f"))).withColumn("__d", F.col(value) - F.col("__ref"))
    per_seed = d.groupBy(variant, seed).agg(F.avg("__d").alias("__ds"), F.avg(value).alias("__vs"))
    per_fold = d.groupBy(variant, fold).agg(F.avg("__d").alias("__df")).groupBy(variant).agg(F.min("__df").alias("lo"), F.max("__df").alias("hi"))
    a = per_seed.groupBy(variant).agg(F.avg("__vs").alias("mean"), F.avg("__ds").alias("delta"), (F.coalesce(F.stddev_samp("__ds"), F.lit(0.0)) / F.sqrt(F.count("__ds"))).alias("error"), F.sum((F.col("__ds") > 0).cast("long")).alias("better_seeds"))
    verdict = (
        F.when(F.col(variant) == reference, "referencia").when(F.abs("delta") <= 2 * F.col("error"), "indistinguible").when(F.col("lo") > 0, "mejor").when(F.col("hi") < 0, "peor").otherwise("mixto")
    )
    return a.join(per_fold, variant).select(variant, "mean", "delta", "error", "better_seeds", verdict.alias("verdict"))


def canary_test(importance: DataFrame, feature: str, block: str, gain: str, canary_prefix: str = "canarito", least: int = 3) -> DataFrame:
    """``feature, block, mean_gain, noise``: a feature whose mean gain is no higher than the best random column's is noise."""
    m = importance.groupBy(feature, block).agg(F.avg(gain).alias("mean_gain")).withColumn("__c", F.col(feature).startswith(canary_prefix))
    best = m.where("__c").agg(F.max("mean_gain").alias("__best"), F.count(F.lit(1)).alias("__n"))
    if best.first()["__n"] < least:
        raise ValueError(f"at least {least} canaries are needed")
    return m.where("not __c").crossJoin(F.broadcast(best)).select(feature, block, "mean_gain", (F.col("mean_gain") <= F.col("__best")).alias("noise"))  # one row


def noise_by_block(tested: DataFrame, block: str) -> DataFrame:
    return tested.groupBy(block).agg(F.count(F.lit(1)).alias("features"), (F.avg(F.col("noise").cast("double")) * 100).alias("noise_pct"))


def public_parts(population: DataFrame, entity: str, positive: str, sims: int, share: float, seed: int) -> DataFrame:
    """``sim, entity, positive, public``: in every simulation, of the positives and of the others each exactly ``share`` (rounded, half to even) are public, by hash order."""
    e = population.select(F.col(entity).alias("entity"), F.col(positive).alias("positive")).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("u", uniform("entity", "sim", seed=seed))
    r = running_in_groups(stage(e, "simulated"), ["sim", "positive"], "u", ["entity"])
    return r.select("sim", F.col("entity").alias(entity), F.col("positive").alias(positive), (F.col("pos") <= F.bround(F.col("n") * F.lit(float(share)), 0)).alias("public"))


def simulate_public_private(population: DataFrame, sent: DataFrame, model: str, entity: str, positive: str, hit: int, miss: int, sims: int, share: float, seed: int) -> DataFrame:
    """``model, public_mean, public_std, private_mean, private_std, wins, wins_private, regret``: how a choice by the public part fares on the private one.

    population: one row per entity that was scored, with its label; sent: one
    row per model and entity sent.  ``public_parts`` splits the population, the
    gains of either part are divided by the share really reached.  wins: how
    often the model is the public winner (ties to the first name), wins_private:
    how often it then has the best private gain too, regret: what it then lacks
    to the best private gain, on average.
    """
    parts = stage(public_parts(population, entity, positive, sims, share, seed), "parts")
    reached = parts.groupBy("sim").agg(F.avg(F.col("public").cast("double")).alias("p"))
    g = F.when(F.col(positive), F.lit(hit)).otherwise(F.lit(-miss))
    sums = parts.join(sent.select(model, entity), entity).groupBy("sim", model).agg(F.sum(F.when(F.col("public"), g).otherwise(0)).alias("a"), F.sum(F.when(~F.col("public"), g).otherwise(0)).alias("b"))
    both = sums.join(reached, "sim").select("sim", model, F.try_divide(F.col("a"), F.col("p")).alias("a"), F.try_divide(F.col("b"), 1 - F.col("p")).alias("b"))
    w = Window.partitionBy("sim")  # one row a model
    r = both.withColumns({"best": F.max("b").over(w), "won": F.row_number().over(w.orderBy(F.col("a").desc(), model)) == 1})
    won = F.col("won")
    return r.groupBy(model).agg(
        F.avg("a").alias("public_mean"), F.stddev_pop("a").alias("public_std"), F.avg("b").alias("private_mean"), F.stddev_pop("b").alias("private_std"), F.sum(won.cast("long")).alias("wins"),
        F.sum((won & (F.col("b") == F.col("best"))).cast("long")).alias("wins_private"), F.avg(F.when(won, F.col("best") - F.col("b"))).alias("regret"),
    )


def winner_risk(simulated: DataFrame) -> DataFrame:
    """``sims, loses, regret`` over all models: the share of simulations whose public winner does not win the private part, and the mean regret."""
    return simulated.agg(F.sum("wins").alias("sims"), (1 - F.sum("wins_private") / F.sum("wins")).alias("loses"), (F.sum(F.coalesce(F.col("regret") * F.col("wins"), F.lit(0.0))) / F.sum("wins")).alias("regret"))


def shooters(n_shooters: int, shots: int, rate_best: float, rate_rest: float, sims: int, seed: int, spark) -> DataFrame:
    """``sims, picked_best``: how often the truly best of many shooters has the most hits (ties count for it only if it is first)."""
    grid = spark.range(sims * n_shooters).select((F.col("id") / n_shooters).cast("long").alias("sim"), (F.col("id") % n_shooters).alias("shooter"))
    hits = sum((uniform("sim", "shooter", F.lit(k), seed=seed) < F.when(F.col("shooter") == 0, rate_best).otherwise(rate_rest)).cast("int") for k in range(shots))
    best = grid.withColumn("hits", hits).groupBy("sim").agg(F.max(F.struct("hits", (-F.col("shooter")).alias("s"))).alias("b"))
    return best.agg(F.count(F.lit(1)).alias("sims"), F.avg((F.col("b.s") == 0).cast("double")).alias("picked_best"))
