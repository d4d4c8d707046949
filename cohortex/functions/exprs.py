"""Null-safe column expressions of the feature families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_sum(*cols: Column | str) -> Column:
    """Sum with nulls as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def safe_ratio(a: Column | str, b: Column | str, null_as_zero: bool = False) -> Column:
    """a / b; null where b is 0 or either is null; with ``null_as_zero`` a null numerator is 0."""
    top = F.coalesce(_c(a), F.lit(0)) if null_as_zero else _c(a)
    return top / F.nullif(_c(b).cast("double"), F.lit(0.0))


def delta_pct(now: Column | str, before: Column | str) -> Column:
    """Change relative to the size of what was before."""
    return (_c(now) - _c(before)) / F.nullif(F.abs(_c(before)).cast("double"), F.lit(0.0))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi)))


def null_count(*cols: str) -> Column:
    """How many of ``cols`` are null in the row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def right_closed(x: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Bins (a, b], the first one closed on both sides; null outside."""
    x, out = _c(x), None
    for k, label in enumerate(labels):
        inside = (x >= edges[k] if k == 0 else x > edges[k]) & (x <= edges[k + 1])
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def left_closed(x: Column | str, edges: list[float]) -> Column:
    """Index of the bin [a, b), the last one closed; null outside."""
    x, out = _c(x), None
    last = len(edges) - 2
    for k in range(last + 1):
        inside = (x >= edges[k]) & ((x <= edges[k + 1]) if k == last else (x < edges[k + 1]))
        out = F.when(inside, F.lit(k)) if out is None else out.when(inside, F.lit(k))
    return out


def is_infinite(x: Column | str) -> Column:
    return F.abs(_c(x)) == F.lit(float("inf"))


#: How entity and period are joined into one number, and the constants of splitmix64.
ENTITY_FACTOR = 1_000_003
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64_uniform(entity: Column | str, period: Column | str, seed: int) -> Column:
    """A number in [0, 1) from entity, period and seed: splitmix64 of (entity * ENTITY_FACTOR + period) xor seed, its upper 53 bits.

    Products wrap modulo 2**64, which ANSI longs refuse, so it runs in Arrow
    batches on unsigned integers.  Null where entity or period is null.
    """
    import numpy as np
    import pandas as pd

    def draw(e: pd.Series, p: pd.Series) -> pd.Series:
        known = (e.notna() & p.notna()).to_numpy()
        a, b = (c.fillna(0).to_numpy(np.int64).view(np.uint64) for c in (e, p))
        with np.errstate(over="ignore"):
            z = ((a * np.uint64(ENTITY_FACTOR) + b) ^ np.uint64(seed)) + np.uint64(GOLDEN)
            for shift, factor in ((30, MIX_1), (27, MIX_2)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
        return pd.Series((z >> np.uint64(11)) * 2.0**-53).where(known)

    draw.__annotations__ = {"e": pd.Series, "p": pd.Series, "return": pd.Series}
    return F.pandas_udf(draw, "double")(_c(entity).cast("long"), _c(period).cast("long"))


def normal(*keys: Column | str, seed: int = 0) -> Column:
    """A standard normal draw from the hash of ``keys``, the same on every run (Box and Muller's transform of two uniform ones)."""
    from cohortex.operators.ranking import uniform

    radius = F.sqrt(-2 * F.log(1 - uniform(*keys, seed=2 * seed)))
    return radius * F.cos(2 * F.pi() * uniform(*keys, seed=2 * seed + 1))
