"""Samples that follow target category proportions, from mergeable reservoirs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.operators.ranking import running_in_groups, uniform
from cohortex.staging import release, stage


@dataclass
class Sample:
    """``rows``: the sample; ``report``: one row per target row with what could be met."""

    rows: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class Goal:
    """What a category wants: a share of the sample and a minimum of rows."""

    share: float
    minimum: int


def reservoirs(df: DataFrame, category: str, key: str, goals: dict[str, Goal], fraction: float, seed: int) -> DataFrame:
    """One pass over ``df``: per task and category the rows whose priority is at most a threshold, the threshold, and the number of rows seen.

    A row's priority u is the hash of its key.  A reservoir is complete below
    its threshold, so reservoirs of different tasks, days or loads merge: take
    their union, add the counts, and cut at the lowest threshold.  Output:
    ``category, key, u`` for kept rows; ``category, null, u, seen`` with u the
    threshold for counts (``seen`` is null on kept rows).  Categories without a
    goal are counted, not kept.

    Nothing is held but counts and, per category, ``minimum`` priorities: rows
    leave with their batch.  The threshold starts at 1 and only falls, to what
    the task's own make-up says that the wanted share needs, with some room
    (or to the priority of the ``minimum``-th row, if that is higher).  Where
    the tasks differ in make-up it may fall too low; whoever merges sees that by
    counting.
    """

    def one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        bound: dict[str, float] = {}
        lowest: dict[str, np.ndarray] = {}
        total = 0
        for batch in batches:
            codes, cats = pd.factorize(batch["category"])
            u, total = batch["u"].to_numpy(), total + len(batch)
            limit = np.full(len(cats), -1.0)
            for k, (cat, n) in enumerate(zip(cats, np.bincount(codes))):
                seen[cat] = seen.get(cat, 0) + int(n)
                g = goals.get(cat)
                if g is None:
                    continue
                need = (1.25 + 5 / np.sqrt(seen[cat])) * g.share * fraction * total / seen[cat] if total >= SETTLED else 1.0
                if g.minimum:
                    few = np.sort(np.concatenate((lowest.get(cat, np.zeros(0)), u[codes == k])))[: g.minimum]
                    lowest[cat] = few
                    need = max(need, few[-1] if len(few) == g.minimum else 1.0)
                limit[k] = bound[cat] = min(bound.get(cat, 1.0), need)
            kept = batch[u <= limit[codes]]
            if len(kept):
                yield kept.assign(seen=pd.array([None] * len(kept), dtype="Int64"))
        for cat, n in seen.items():
            yield pd.DataFrame({"category": [cat], "key": pd.array([None], dtype="Int64"), "u": [bound.get(cat, 1.0)], "seen": pd.array([n], dtype="Int64")})

    return _prioritised(df, category, key, seed).mapInPandas(one_task, "category string, key long, u double, seen long")


#: Rows a task must have seen before its make-up sets thresholds.
SETTLED = 5_000


def _prioritised(df: DataFrame, category: str, key: str, seed: int) -> DataFrame:
    slim = df.select(F.col(category).alias("category"), F.col(key).cast("long").alias("key")).where("category is not null")
    return slim.withColumn("u", uniform("key", seed=seed))


def proportional_sample(df: DataFrame, key: str, category: str, targets: DataFrame, share: str, minimum: str, fraction: float, seed: int = 11, keep_shares: bool = False) -> Sample:
    """A sample of ``fraction`` of the categorised rows of ``df``, with each category's share and minimum from ``targets``.

    df: ``key`` (unique integer) and ``category`` (string; null rows take no
    part).  targets: one row per category with ``category``, ``share`` and
    ``minimum``; the table is the caller's, fixed and small, and is read to the
    driver.  Null shares or minima count as 0; of repeated categories one stays.

    S is floor(fraction * categorised rows).  A category wants
    max(minimum, share * S) rows and gets that rounded up, or all it has: then
    it is exhausted, and the report says so (``met`` false).  With
    ``keep_shares`` all quotas but the minima are lowered by one common factor,
    the highest with which no category that has rows is exhausted by its share:
    the shares are then kept, at the cost of size.

    Reservoirs are trimmed uniformly: the rows with the lowest hash priorities
    stay, found by slices of the priority, so no task sorts a whole category.
    A reservoir that holds fewer rows than its quota though there are more is
    filled from ``df`` by priority, which costs another pass.
    """
    goals = {r["category"]: Goal(float(r[share] or 0), int(r[minimum] or 0)) for r in targets.select(F.col(category).alias("category"), share, minimum).where("category is not null").collect()}
    pool = stage(reservoirs(df, category, key, goals, fraction, seed), "reservoirs")
    per = {r["category"]: r for r in pool.where("seen is not null").groupBy("category").agg(F.sum("seen").alias("n"), F.min("u").alias("bound")).where(F.col("category").isin(list(goals))).collect()}
    s = int(np.floor(fraction * (pool.agg(F.sum("seen")).first()[0] or 0) + 1e-9))
    have = {c: per[c]["n"] if c in per else 0 for c in goals}
    scale = min([1.0, *[have[c] / (g.share * s) for c, g in goals.items() if keep_shares and g.share * s > 0 and have[c]]])
    rows = []
    for c, g in goals.items():
        want = max(float(g.minimum), g.share * s)
        quota = min(have[c], int(np.ceil(max(float(g.minimum), scale * g.share * s) - 1e-9)))
        rows.append((c, g.share, g.minimum, want, have[c], quota, have[c] >= want - 1e-9))
    spark = df.sparkSession
    report = spark.createDataFrame(rows, "category string, share double, minimum int, wanted double, available long, quota long, met boolean")
    ends = spark.createDataFrame([(c, float(per[c]["bound"])) for c in goals if c in per], "b_category string, bound double")
    kept = pool.where("seen is null").join(F.broadcast(ends), (F.col("category") == F.col("b_category")) & (F.col("u") <= F.col("bound"))).select("category", "key", "u")  # one row per target category
    held = {r["category"]: r["n"] for r in kept.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    lacking = {c: q for c, _, _, _, _, q, _ in rows if held.get(c, 0) < q}
    if lacking:
        kept = kept.where(~F.col("category").isin(list(lacking))).unionByName(_refill(df, category, key, lacking, have, seed))
    ranked = running_in_groups(kept, ["category"], "u", ["key"])
    quota = report.select(F.col("category").alias("q_category"), "quota")
    sample = ranked.join(F.broadcast(quota), (F.col("category") == F.col("q_category")) & (F.col("pos") <= F.col("quota"))).select(F.col("key").alias(key), F.col("category").alias(category))  # one row per target category
    drawn = sum(r[5] for r in rows)
    report = report.withColumn("reached_share", F.try_divide(F.col("quota").cast("double"), F.lit(float(drawn)))).withColumnRenamed("category", category)
    return Sample(sample, report)


def _refill(df: DataFrame, category: str, key: str, quota: dict[str, int], have: dict[str, int], seed: int) -> DataFrame:
    """The rows of the categories in ``quota`` whose priorities are low enough to hold the quota's lowest: counts are known now."""
    spark = df.sparkSession
    room = 1.0
    while True:
        ends = {c: min(1.0, room * (q + 6 * q**0.5 + 20) / max(1, have[c])) for c, q in quota.items()}
        t = F.broadcast(spark.createDataFrame(list(ends.items()), "b_category string, bound double"))  # one row per target category
        got = stage(_prioritised(df, category, key, seed).join(t, (F.col("category") == F.col("b_category")) & (F.col("u") <= F.col("bound"))).select("category", "key", "u"), "refill")
        held = {r["category"]: r["n"] for r in got.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(held.get(c, 0) >= q or ends[c] >= 1.0 for c, q in quota.items()):
            return got
        release(got)
        room *= 4
