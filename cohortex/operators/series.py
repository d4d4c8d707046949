"""Families of features over an entity's own past, on the dense panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions.exprs import delta_pct, safe_ratio


@dataclass
class Catalog:
    """One source of truth for names, expressions and origins of features; a repeated name is an error."""

    rows: list[tuple[str, str, str, str]] = field(default_factory=list)

    def add(self, block: str, feature: str, expression: str, origin: str) -> str:
        if any(r[1] == feature for r in self.rows):
            raise ValueError(f"feature {feature!r} is there already")
        self.rows.append((block, feature, expression, origin))
        return feature

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "bloque string, feature string, expresion string, origen string")


@dataclass(frozen=True)
class SeriesSpec:
    """Which families to build for each field; windows cover the ``window`` periods before and the current one."""

    lags: tuple[int, ...] = (1, 2)
    deltas: tuple[int, ...] = (1, 2)
    delta_pcts: tuple[int, ...] = (1, 2)
    stats: tuple[str, ...] = ("avg", "max", "min", "stddev")
    window: int = 3
    ratio: bool = True
    trend_against: str | None = None


_STATS = {"avg": F.avg, "max": F.max, "min": F.min, "stddev": F.stddev_samp}


def add_series(panel: DataFrame, entity: str, period: str, fields: list[str], spec: SeriesSpec = SeriesSpec(), catalog: Catalog | None = None) -> DataFrame:
    """``panel`` with the series features, in two projections: lags and window statistics, then what is computed from them.

    Runs on the dense panel, ghost rows included, so that lag 2 is two periods
    back and not two rows.  All features look backwards.  Lags needed only for
    deltas are dropped.  The same window spec is shared by all features of a
    frame, so Spark sorts each entity once.
    """
    cat = catalog if catalog is not None else Catalog()
    order = Window.partitionBy(entity).orderBy(period)
    frame = order.rowsBetween(-spec.window, 0)
    need = sorted({*spec.lags, *spec.deltas, *spec.delta_pcts})
    first: dict[str, Column] = {}
    for c in fields:
        for n in need:
            first[f"lag_{n}_{c}"] = F.lag(c, n).over(order)
        for s in {*spec.stats} | ({"avg"} if spec.ratio else set()):
            first[f"{s}_{spec.window}_{c}"] = _STATS[s](c).over(frame)
        if spec.trend_against:
            first[f"trend_{spec.window}_{c}"] = F.regr_slope(F.col(c).cast("double"), F.col(spec.trend_against).cast("double")).over(frame)
    first["present_so_far"] = F.sum("present").over(order.rowsBetween(Window.unboundedPreceding, 0))
    first["place"] = F.row_number().over(order)
    wide = panel.withColumns(first)
    second: dict[str, Column] = {}
    for c in fields:
        for n in spec.deltas:
            second[cat.add("deltas", f"delta_{n}_{c}", f"{c} - lag_{n}_{c}", c)] = F.col(c) - F.col(f"lag_{n}_{c}")
        for n in spec.delta_pcts:
            second[cat.add("deltas_pct", f"deltapct_{n}_{c}", f"({c} - lag_{n}_{c}) / abs(lag_{n}_{c})", c)] = delta_pct(c, f"lag_{n}_{c}")
        if spec.ratio:
            second[cat.add("ratios", f"ratio_avg_{spec.window}_{c}", f"{c} / avg_{spec.window}_{c}", c)] = safe_ratio(c, f"avg_{spec.window}_{c}")
        for n in spec.lags:
            cat.add("lags", f"lag_{n}_{c}", f"lag({c}, {n})", c)
        for s in spec.stats:
            cat.add("windows", f"{s}_{spec.window}_{c}", f"{s}({c}) over {spec.window + 1} rows", c)
        if spec.trend_against:
            cat.add("trends", f"trend_{spec.window}_{c}", f"regr_slope({c}, {spec.trend_against})", c)
    out = wide.withColumns(second)
    hidden = [f"lag_{n}_{c}" for c in fields for n in need if n not in spec.lags]
    hidden += [f"avg_{spec.window}_{c}" for c in fields if spec.ratio and "avg" not in spec.stats]
    return out.drop(*hidden)


def check_no_future(df: DataFrame) -> None:
    """Raise if the plan of ``df`` looks ahead: a lead, or a window frame that ends after the current row."""
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    import re

    if re.search(r"\blead\(", plan) or re.search(r"specifiedwindowframe\(\w+, [^,()$]+\$?\(?\)?, (?:[1-9]\d*|unboundedfollowing)", plan):
        raise ValueError("a feature looks into the future")
