"""Totals and averages over trailing periods, idle periods included.

Every period's amount becomes two events: it is added at its own period and
taken away when it leaves the window, so the total of any window length is one
running sum over the events.  Amounts are summed as decimals; what was added is
taken away exactly, and a total that should be zero is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions.periods import month_index, month_key


def _index(period: str, calendar: str) -> Column:
    if calendar == "month":
        return month_index(period)
    if calendar == "day":
        return F.unix_date(F.col(period).cast("date"))
    if calendar == "int":
        return F.col(period).cast("int")
    raise ValueError(f"unknown calendar {calendar!r}: month, day or int")


def _period(index: str, calendar: str) -> Column:
    if calendar == "month":
        return month_key(index)
    if calendar == "day":
        return F.date_from_unix_date(F.col(index))
    return F.col(index)


def rolling_totals(
    df: DataFrame, entity: str, period: str, amounts: Sequence[str], windows: Sequence[int], calendar: str = "month", scale: int = 4
) -> DataFrame:
    """One row for each entity and period from its first to its last, with ``<amount>_total_<w>`` and ``<amount>_avg_<w>``.

    calendar: ``month`` (YYYYMM keys), ``day`` (dates or timestamps) or ``int``.
    All rows of an entity and period are summed.  Null, NaN and infinite
    amounts and missing periods count as 0; amounts are taken to ``scale``
    decimal places.  Totals are decimals, averages are total / w as doubles,
    also where the entity is younger than the window.  Rows with a null entity
    or a period that is null or not a calendar month belong nowhere and are
    left out; an empty table gives an empty result.

    Shuffles: one on (entity, period) after partial sums, so an entity with a
    third of all rows is spread over its periods and pre-aggregated; one on
    entity of at most one row a period.  The events are grouped and run over
    within that same partitioning.
    """
    if not amounts or not windows or min(windows) < 1:
        raise ValueError("amounts and windows must be given, windows of 1 or more periods")
    sizes = sorted(set(windows))
    small = f"decimal({min(38, 27 + scale)},{scale})"
    as_decimal = lambda c: F.coalesce(
        F.expr(f"try_cast(nanvl(cast(`{c}` as double), null) as {small})") if dict(df.dtypes)[c] in ("double", "float") else F.expr(f"try_cast(`{c}` as {small})"),
        F.lit(0).cast(small),
    )
    cells = (
        df.select(F.col(entity).alias("e"), _index(period, calendar).alias("t"), *(as_decimal(c).alias(f"v{i}") for i, c in enumerate(amounts)))
        .where("e is not null and t is not null")
        .groupBy("e", "t")
        .agg(*(F.sum(f"v{i}").cast(f"decimal(38,{scale})").alias(f"v{i}") for i in range(len(amounts))))
    )
    by_entity = Window.partitionBy("e")
    placed = cells.select("*", F.lead("t").over(by_entity.orderBy("t")).alias("next"), F.max("t").over(by_entity).alias("last"))

    nothing = F.lit(0).cast(f"decimal(38,{scale})")
    names = [(i, w) for i in range(len(amounts)) for w in sizes]

    def event(at: Column, value) -> Column:
        return F.struct(at.cast("int").alias("at"), *(value(i, w).cast(f"decimal(38,{scale})").alias(f"d{i}_{w}") for i, w in names))

    entering = F.array(event(F.col("t"), lambda i, w: F.col(f"v{i}")))
    leaving = [
        F.when(F.col("t") + gone <= F.col("last"), F.array(event(F.col("t") + gone, lambda i, w, gone=gone: -F.col(f"v{i}") if w == gone else nothing))).otherwise(
            F.expr("array()").cast(f"array<struct<at:int,{','.join(f'd{i}_{w}:decimal(38,{scale})' for i, w in names)}>>")
        )
        for gone in sizes
    ]
    idle = F.when(
        F.col("next") > F.col("t") + 1,
        F.transform(F.sequence(F.col("t") + 1, F.col("next") - 1), lambda at: event(at, lambda i, w: nothing)),
    ).otherwise(F.expr("array()").cast(f"array<struct<at:int,{','.join(f'd{i}_{w}:decimal(38,{scale})' for i, w in names)}>>"))
    events = placed.select("e", F.explode(F.concat(entering, *leaving, idle)).alias("x")).select("e", "x.*")
    deltas = events.groupBy("e", "at").agg(*(F.sum(f"d{i}_{w}").alias(f"d{i}_{w}") for i, w in names))
    running = by_entity.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = deltas.select("e", "at", *(F.sum(f"d{i}_{w}").over(running).cast(f"decimal(38,{scale})").alias(f"d{i}_{w}") for i, w in names))
    out = []
    for i, c in enumerate(amounts):
        for w in sizes:
            out.append(F.col(f"d{i}_{w}").alias(f"{c}_total_{w}"))
            out.append((F.col(f"d{i}_{w}").cast("double") / w).alias(f"{c}_avg_{w}"))
    return totals.select(F.col("e").alias(entity), _period("at", calendar).alias(period), *out)
