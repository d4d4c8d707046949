"""Ranks and rescaled amounts inside a period, stable under ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.operators.ranking import BROADCAST_ROWS, _join, _small, quantiles, value_ranks, with_ranks
from cohortex.staging import release, released, stage


#: Fields are ranked in turns of so many values, or of TURN_FIELDS full fields of a larger table: the disk holds the long form of a few only.
TURN_VALUES, TURN_FIELDS = 2_000_000, 3


def percent_ranks(df: DataFrame, group: str, fields: list[str], key: list[str]) -> DataFrame:
    """``key`` columns, ``group`` and ``pr_<f>``, ``dec_<f>`` for each field: rank in [0, 1] among non-null values, and its decile.

    Null stays null and does not move the others; ties share rank and decile.
    """
    below, n = rank_counts(df, group, fields, key)
    return with_percent_ranks(below, n, group, fields).select(*key, group, *[f"{k}_{f}" for f in fields for k in ("pr", "dec")])


def with_percent_ranks(df: DataFrame, n: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """``df``, which has the columns ``__below_<f>`` of ``rank_counts``, with ``pr_<f>`` and ``dec_<f>`` in their place."""
    out = df.join(n, df[group].eqNullSafe(n["__ng"]), "left")  # one row a group
    pr = {f: F.when(F.col(f"__below_{f}").isNotNull(), F.coalesce(F.try_divide(F.col(f"__below_{f}").cast("double"), (F.col(f"__n_{f}") - 1).cast("double")), F.lit(0.0))) for f in fields}
    out = out.withColumns({f"pr_{f}": c for f, c in pr.items()}).drop("__ng", *[f"__{k}_{f}" for f in fields for k in ("below", "n")])
    return out.withColumns({f"dec_{f}": F.when(F.col(f"pr_{f}").isNotNull(), F.least(F.lit(10), F.floor(F.col(f"pr_{f}") * 10 + 1e-9) + 1)).cast("int") for f in fields})


def rank_counts(df: DataFrame, group: str, fields: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """``key, group, __below_<f>`` (how many values of the group are smaller; null for null), staged; and the groups' ``__ng, __n_<f>`` non-null values.

    Long form: the fields are unpivoted and ranked together, by distinct value,
    so many fields cost one ordering, and no period is sorted in one task.  Of
    a large table a few fields at a time, the columns of each turn being added
    to those before.  Counts take half the disk of ranks.
    """
    spark = df.sparkSession
    with released(spark) as kept:
        df = stage(df.select(*key, group, *fields), "ranked")  # read again and again: to count values and to give them back
        counts = stage(df.groupBy(F.col(group).alias("__ng")).agg(F.count(F.lit(1)).alias("__rows"), *[F.count(f).alias(f"__n_{f}") for f in fields]), "group_sizes")
        sizes = counts.agg(*[F.sum(c) for c in ("__rows", *(f"__n_{f}" for f in fields))]).first()
        turns, held, most = [[]], 0, max(TURN_VALUES, TURN_FIELDS * (sizes[0] or 0))
        for f, size in zip(fields, sizes[1:]):
            if turns[-1] and held + (size or 0) > most:
                turns, held = [*turns, []], 0
            turns[-1].append(f)
            held += size or 0
        done = None
        for turn in turns:
            with released(spark) as mine:
                part = _below(df, group, turn, key)
                if done is not None:
                    b = part.select(*[F.col(c).alias(f"__r_{c}") for c in (*key, group)], *[f"__below_{f}" for f in turn])
                    cond = F.lit(True)
                    for c in (*key, group):
                        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
                    part = done.join(b, cond).drop(*[f"__r_{c}" for c in (*key, group)])
                part = stage(part, "below")
                mine.append(part)
            if done is not None:
                release(done)
            done = part
        kept += [done, counts]
    return done, _small_if_short(counts.drop("__rows"))


def _small_if_short(copy: DataFrame) -> DataFrame:
    return F.broadcast(copy) if copy.count() <= BROADCAST_ROWS else copy


def _below(df: DataFrame, group: str, fields: list[str], key: list[str]) -> DataFrame:
    """``key, group, __below_<f>`` of every row; rows are taken to be one for each key and group."""
    parts = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("x")) for i, f in enumerate(fields)])
    long = df.select(*key, group, F.explode(F.filter(parts, lambda p: p["x"].isNotNull())).alias("v")).select(*key, group, "v.f", "v.x")
    with released(df.sparkSession) as kept:
        r = stage(value_ranks(long, [group, "f"], "x").select(F.col(group).alias("__g"), F.col("f").alias("__f"), F.col("x").alias("__x"), "below"), "value_ranks")
        kept.append(r)
    r = _small_if_short(r)
    found = long.join(r, F.col(group).eqNullSafe(F.col("__g")) & (F.col("f") == F.col("__f")) & (F.col("x") == F.col("__x"))).select(*key, group, "f", "below")
    every = df.select(*key, group, F.lit(-1).alias("f"), F.lit(None).cast("long").alias("below"))  # so that rows without values stay
    return found.unionAll(every).groupBy(*key, group).agg(*[F.max(F.when(F.col("f") == i, F.col("below"))).alias(f"__below_{f}") for i, f in enumerate(fields)])


def signed_ranks(df: DataFrame, group: str, fields: list[str], key: list[str]) -> DataFrame:
    """``sr_<f>``: per group and sign, positives in (0, 1], zero 0, negatives in [-1, 0); null stays null.

    The share of the same sign's values that are no further from zero.
    """
    df = stage(df.select(*key, group, *fields), "ranked")
    long = _unpivot(df, group, fields, key).withColumn("sign", F.signum("x").cast("int"))
    r = with_ranks(long.withColumn("size", F.when(F.col("sign") != 0, F.abs("x"))), [group, "field", "sign"], "size")  # zeros, often a third of all, need no rank
    sr = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * (F.col("below") + F.col("same")) / F.col("n"))
    return _widen(r.select(*key, group, "field", F.when(F.col("x").isNotNull(), sr).alias("sr")), key, group, fields, {"sr": F.col("sr")})


def deflated(df: DataFrame, group: str, fields: list[str], accuracy: int | None = 10_000) -> DataFrame:
    """``df`` with ``df_<f>``: the amount over the group's median positive amount; null where no amount is positive.

    The medians of all fields are one table of one row per group, joined back;
    merged from summaries of rank error 1 / ``accuracy``, or exact without
    (``quantiles``: no group is ordered in one task).
    """
    groups = df.select(group).distinct()
    if accuracy:
        m = df.groupBy(group).agg(*[F.percentile_approx(F.when(F.col(f) > 0, F.col(f).cast("double")), 0.5, accuracy).alias(f"__m_{f}") for f in fields])
    else:
        q = quantiles(_unpivot(df, group, fields, []).where("x > 0"), [group, "field"], "x", [0.5], None)
        m = q.groupBy(group).agg(*[F.max(F.when(F.col("field") == f, F.col("q")[0])).alias(f"__m_{f}") for f in fields])
        m = groups.join(m.withColumnRenamed(group, "__mg"), F.col(group).eqNullSafe(F.col("__mg")), "left").drop("__mg")
    out = _join(df, _small(m), [group])
    return out.withColumns({f"df_{f}": F.col(f) / F.nullif(F.col(f"__m_{f}"), F.lit(0.0)) for f in fields}).drop(*[f"__m_{f}" for f in fields])


def _unpivot(df: DataFrame, group: str, fields: list[str], key: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    return df.select(*key, group, F.explode(parts).alias("v")).select(*key, group, "v.field", "v.x")


def _widen(long: DataFrame, key: list[str], group: str, fields: list[str], outs: dict[str, Column]) -> DataFrame:
    named = long.select(*key, group, "field", *[c.alias(k) for k, c in outs.items()])
    return named.groupBy(*key, group).agg(*[F.max(F.when(F.col("field") == f, F.col(k))).alias(f"{k}_{f}") for f in fields for k in outs])


def ntiles(df: DataFrame, group: str, field: str, tie: str, tiles: list[int]) -> DataFrame:
    """``df`` with ``place`` and ``ntile_<k>``: rows split into k parts of nearly equal size, larger parts first, nulls last, ties by ``tie``."""
    from cohortex.operators.ranking import running_by_order

    n = _small(df.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")))
    r = _join(running_by_order(df, [group], [F.col(field).asc_nulls_last(), F.col(tie).asc()]), n, [group])
    out = {"place": F.col("pos")}
    for k in tiles:
        q, m, i = F.floor(F.col("__rows") / k), F.col("__rows") % k, F.col("pos") - 1
        out[f"ntile_{k}"] = F.when(i < m * (q + 1), F.floor(i / (q + 1))).otherwise(m + F.floor((i - m * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int") + 1
    return r.withColumns(out).drop("pos", "__rows")


def average_rank(df: DataFrame, groups: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """``df`` with the rank of ``value`` (1-based, ties averaged) in its groups; null for null."""
    r = with_ranks(df, groups, value, "__")
    return r.withColumn(name, F.col("__below") + (F.col("__same") + 1) / 2).drop("__below", "__same", "__n")


__all__ = ["average_rank", "deflated", "ntiles", "percent_ranks", "rank_counts", "signed_ranks", "value_ranks", "with_percent_ranks"]
