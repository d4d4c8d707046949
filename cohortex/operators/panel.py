"""Dense entity x period panels and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions.periods import month_index, month_range


def observed_periods(df: DataFrame, period: str) -> list[int]:
    """Distinct periods of the table, in order; one number per calendar month reaches the driver."""
    return sorted(r[0] for r in df.select(period).where(F.col(period).isNotNull()).distinct().collect())


def calendar_periods(fact: DataFrame, period: str, calendar: str) -> list[int]:
    """``observed``: the periods that occur in the table; ``full``: all months from the first to the last."""
    periods = observed_periods(fact, period)
    return month_range(periods[0], periods[-1]) if calendar == "full" and periods else periods


def _grid(fact: DataFrame, entity: str, period: str, periods: list[int]) -> DataFrame:
    return fact.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods]).cast("array<int>")))


def ghost_rows(fact: DataFrame, entity: str, period: str, periods: list[int]) -> DataFrame:
    """``entity, period`` of the panel's rows that the fact lacks; only these two columns are shuffled, not the fact."""
    return _grid(fact, entity, period, periods).join(fact.select(entity, period), [entity, period], "left_anti")


def dense_panel(fact: DataFrame, entity: str, period: str, calendar: str = "observed") -> DataFrame:
    """Every entity in every period: the fact's rows, and ghost rows with ``present`` 0 and nulls.

    calendar: ``observed`` (periods that occur in the table) or ``full`` (all
    months from the first to the last).  The periods are a short literal
    array that every entity is exploded with; there is no join of entities and
    periods.  The fact must hold one row per entity and period.
    """
    grid = _grid(fact, entity, period, calendar_periods(fact, period, calendar))
    return grid.join(fact.withColumn("present", F.lit(1)), [entity, period], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def churn_target(fact: DataFrame, entity: str, period: str, calendar: str = "observed", labels=("CONTINUA", "BAJA+1", "BAJA+2")) -> DataFrame:
    """``entity, period, target`` of every present row, by looking two periods ahead on the dense panel.

    Present two ahead: stays.  Present next, absent after: leaves in two.
    Absent next (and not back after): leaves next.  Null where the panel does
    not reach far enough.
    """
    w = Window.partitionBy(entity).orderBy(period)
    p = dense_panel(fact.select(entity, period).distinct(), entity, period, calendar)
    p = p.select(entity, period, "present", F.lead("present", 1).over(w).alias("next"), F.lead("present", 2).over(w).alias("after"))
    stay, one, two = labels
    target = F.when(F.col("after") == 1, stay).when((F.col("next") == 1) & (F.col("after") == 0), two).when(F.col("next") == 0, one)
    return p.where("present = 1").select(entity, period, target.alias("target"))


def churn_target_by_gaps(fact: DataFrame, entity: str, period: str, last: int | None = None) -> DataFrame:
    """The other reading, over present rows only: absent next month is ``BAJA+1`` even if the entity returns after.

    ``last``: the last period of the data, by default the table's.
    """
    rows = fact.select(entity, period).distinct().withColumn("i", month_index(period))
    end = month_index(F.lit(last)) if last else F.lit(rows.agg(F.max("i")).first()[0])
    w = Window.partitionBy(entity).orderBy("i")
    r = rows.select(entity, period, "i", F.lead("i", 1).over(w).alias("n1"), F.lead("i", 2).over(w).alias("n2"))
    next_, after = F.coalesce(F.col("n1") == F.col("i") + 1, F.lit(False)), F.coalesce(F.col("n2") == F.col("i") + 2, F.lit(False))
    target = F.when(F.col("i") >= end, None).when(~next_, "BAJA+1").when(F.col("i") + 1 >= end, None).when(after, "CONTINUA").otherwise("BAJA+2")
    return r.select(entity, period, target.alias("target"))


def gaps(fact: DataFrame, entity: str, period: str) -> DataFrame:
    """Entities whose periods are not consecutive among the observed ones: ``entity, rows, span``."""
    order = fact.select(F.col(period).alias("p")).distinct()
    numbered = order.withColumn("k", F.dense_rank().over(Window.orderBy("p")))  # one row per calendar period
    r = fact.select(entity, F.col(period).alias("p")).distinct().join(F.broadcast(numbered), "p")
    g = r.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), (F.max("k") - F.min("k") + 1).cast("long").alias("span"))
    return g.where("rows <> span")
