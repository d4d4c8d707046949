"""Combining score tables and comparing the lists they send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.functions.exprs import clip
from cohortex.operators.ranking import _join, running_by_order, with_ranks


def id_set_differences(scores: DataFrame, model: str, entity: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``groups, model, missing``: how many ids of the union (within ``groups``) each model lacks."""
    pairs = scores.select(*groups, model, entity).distinct()
    mine = pairs.groupBy(*groups, model).agg(F.count(F.lit(1)).alias("n"))
    all_ids = pairs.select(*groups, entity).distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("all"))
    both = _join(mine, all_ids, list(groups)) if groups else mine.crossJoin(F.broadcast(all_ids))  # one row
    return both.select(*groups, model, (F.col("all") - F.col("n")).alias("missing"))


def common_entities(scores: DataFrame, model: str, entity: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` of the entities that every model (of the group) has scored."""
    per = scores.groupBy(*groups, entity).agg(F.count_distinct(model).alias("__k"))
    models = scores.groupBy(*groups).agg(F.count_distinct(model).alias("__all"))
    both = _join(per, models, list(groups)) if groups else per.crossJoin(F.broadcast(models))  # one row
    return _join(scores, both.where("__k = __all").select(*groups, entity), [*groups, entity])


def combine(scores: DataFrame, model: str, entity: str, score: str, method: str = "rank", weights: dict[str, float] | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """``groups, entity, prob``: weighted mean over models of the score (``mean``) or of its average rank over n (``rank``), within [0, 1].

    scores: one row per group, model and entity.  Within a group all models
    must score the same entities, there must be two models or more, and weights
    must be positive and name every model; anything else is an error.
    """
    if method not in ("rank", "mean"):
        raise ValueError(f"unknown method {method!r}")
    if not id_set_differences(scores, model, entity, groups).where("missing > 0").isEmpty():
        raise ValueError("the models score different entities")
    names = {r[0] for r in scores.select(model).distinct().collect()}  # one row a model
    if len(names) < 2:
        raise ValueError("an ensemble needs two models or more")
    if weights is not None and (set(weights) != names or min(weights.values()) <= 0):
        raise ValueError(f"weights must be positive and name the models {sorted(names)}")
    if method == "rank":
        x = with_ranks(scores, [*groups, model], score, "__").withColumn("__x", (F.col("__below") + (F.col("__same") + 1) / 2) / F.col("__n"))
    else:
        x = scores.withColumn("__x", F.col(score))
    w = F.coalesce(*[F.when(F.col(model) == m, F.lit(float(v))) for m, v in weights.items()]) if weights else F.lit(1.0)
    mean = F.try_divide(F.sum(F.col("__x") * F.col("__w")), F.sum("__w"))
    return x.withColumn("__w", w).groupBy(*groups, entity).agg(clip(mean, 0.0, 1.0).alias("prob"))


def top_sets(scores: DataFrame, model: str, entity: str, score: str, n: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """``groups, model, entity`` of the n best of every model, ties to the smaller id."""
    r = running_by_order(scores, [*groups, model], [F.col(score).desc(), F.col(entity).asc()])
    return r.where(F.col("pos") <= n).select(*groups, model, entity)


def jaccard(sets: DataFrame, model: str, entity: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``groups, a, b, both, jaccard`` for every two models that share an entity, a < b.

    Per entity its models are gathered (as many as there are models) and
    paired there; the result has one row per group and pair of models.
    """
    n = sets.groupBy(*groups, model).agg(F.count(F.lit(1)).alias("n"))
    per = sets.groupBy(*groups, entity).agg(F.sort_array(F.collect_set(model)).alias("ms"))
    pairs = per.select(*groups, F.explode("ms").alias("a"), "ms").select(*groups, "a", F.explode("ms").alias("b")).where("a < b").groupBy(*groups, "a", "b").agg(F.count(F.lit(1)).alias("both"))
    na, nb = n.select(*groups, F.col(model).alias("a"), F.col("n").alias("na")), n.select(*groups, F.col(model).alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, [*groups, "a"]).join(nb, [*groups, "b"]).select(*groups, "a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
