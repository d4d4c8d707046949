"""The N best items of every group, found by descending score bands."""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.operators.ranking import BROADCAST_ROWS
from cohortex.staging import release, stage


def top_n_banded(df: DataFrame, group: str, score: str, ties: list[Column], n: int, columns: list[str], first: float | None = None) -> DataFrame:
    """The ``n`` rows of every ``group`` with the highest ``score``, ties by ``ties``: ``group, *columns, place``.

    The rows are range-partitioned by score and tie columns (a score that a
    third of the rows share is spread too) and staged.  Score bands are then
    processed from the top.  Groups filled by higher bands are taken out of a
    band by an anti-join before anything is ranked: a broadcast one where the
    filled groups were counted and are few, else a shuffled one whose result is
    staged, so that a hot group may be split there and is again limited map-side
    afterwards.  The band's rows are then ranked within their group, with at
    most n rows of a group leaving any map task, and groups filled in part get
    only what they lack.  Bands are cut between scores, never inside one, so
    exact ranks within a band decide all ties.  Each band holds twice the rows
    of the one above; the loop ends when every group is filled or no row is left.

    Rows with a null group or a null or NaN score do not take part.  Groups
    with fewer rows give what they have.  Rows equal in score and ties come out
    in either order.  An empty table gives an empty result.
    """
    need = list(dict.fromkeys((group, score, *columns)))
    src = df.select(*need).where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = stage(src.repartitionByRange(F.col(score).desc(), *ties), "bands")
    stats = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(group, 0.02).alias("groups"), F.percentile_approx(score, [1 - 2.0**-k for k in range(1, 8)], 5000).alias("q")).first()
    if not stats["rows"]:
        return rows.select(group, *[c for c in columns if c != group], F.lit(1).alias("place")).limit(0)
    if first is None:  # the top band offers about twice the rows wanted
        first = min(0.25, max(2.0**-7, 2.0 * n * stats["groups"] / stats["rows"]))
    k = max(1, min(7, round(-log2(first))))
    edges = list(dict.fromkeys(stats["q"][j - 1] for j in range(k, 0, -1)))  # descending
    bands = [(hi, lo) for hi, lo in zip([None, *edges], [*edges, None])]
    within = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    done: list[DataFrame] = []
    counts = None
    for hi, lo in bands:
        band = rows
        if lo is not None:
            band = band.where(F.col(score) >= F.lit(lo))
        if hi is not None:
            band = band.where(F.col(score) < F.lit(hi))
        thinned = None
        if counts is not None:
            filled = counts.where(F.col("have") >= n).select(group)
            if filled.count() <= BROADCAST_ROWS:
                band = band.join(F.broadcast(filled), group, "left_anti")
            else:
                thinned = band = stage(band.join(filled.hint("merge"), group, "left_anti"), "unfilled")
        best = band.withColumn("place", F.row_number().over(within)).where(F.col("place") <= n)
        if counts is not None:
            part = counts.where(F.col("have") < n)
            best = best.join(part, group, "left").withColumn("place", F.col("place") + F.coalesce("have", F.lit(0))).where(F.col("place") <= n).drop("have")
        got = stage(best.select(group, *[c for c in columns if c != group], "place"), "topn")
        done.append(got)
        if thinned is not None:
            release(thinned)
        if lo is None:
            break
        new = reduce(DataFrame.unionByName, done).groupBy(group).agg(F.count(F.lit(1)).alias("have"))
        if counts is not None:
            release(counts)
        counts = stage(new, "have")
        rest = rows.where(F.col(score) < F.lit(lo)).select(group).distinct()
        if rest.join(counts.where(F.col("have") >= n), group, "left_anti").isEmpty():
            break
    if counts is not None:
        release(counts)
    release(rows)
    return reduce(DataFrame.unionByName, done)
