"""Arithmetic on YYYYMM period keys, as columns and on the driver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(yyyymm: Column | str) -> Column:
    """Linear month number of a YYYYMM key; null for null and for months outside 1..12."""
    c = F.col(yyyymm) if isinstance(yyyymm, str) else yyyymm
    c = c.cast("int")
    month = c % 100
    return F.when(month.between(1, 12), F.floor(c / 100).cast("int") * 12 + month - 1)


def month_key(index: Column | str) -> Column:
    """YYYYMM key of a linear month number."""
    c = F.col(index) if isinstance(index, str) else index
    return (F.floor(c / 12) * 100 + c % 12 + 1).cast("int")


def _number(yyyymm: int) -> int:
    year, month = divmod(yyyymm, 100)
    return 12 * year + month - 1


def _keys(numbers: range) -> list[int]:
    return [100 * (i // 12) + i % 12 + 1 for i in numbers]


def offset(yyyymm: int, n: int) -> int:
    """The key ``n`` calendar months after ``yyyymm``."""
    at = _number(yyyymm) + n
    return _keys(range(at, at + 1))[0]


def month_range(first: int, last: int) -> list[int]:
    """Keys of all months from ``first`` to ``last``, both included; none if they are the wrong way round."""
    return _keys(range(_number(first), _number(last) + 1))


def derive_folds(target: int, gap: int, n_train: int, n_folds: int) -> list[dict]:
    """``n_folds`` folds before ``target``, the latest first: a validation month ``gap`` or more before the target, and the ``n_train`` months that end ``gap`` before it."""
    if min(gap, n_train, n_folds) < 1:
        raise ValueError("gap, n_train and n_folds must be at least 1")
    latest = _number(target) - gap
    return [{"valid": _keys(range(v, v + 1))[0], "train": _keys(range(v - gap - n_train + 1, v - gap + 1))} for v in range(latest, latest - n_folds, -1)]
