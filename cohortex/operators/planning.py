"""Driver-side arithmetic of experiments: seeds, folds, scaled limits, random columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.functions.periods import derive_folds, offset


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    i = 2
    while i * i <= n:
        if n % i == 0:
            return False
        i += 1
    return True


#: The range that seeds must come from.
LOWEST_SEED, HIGHEST_SEED = 100_003, 999_983


def check_seed(seed: int) -> None:
    """Raise unless ``seed`` is a prime in the allowed range."""
    if isinstance(seed, bool) or not isinstance(seed, int):
        raise TypeError(f"a seed must be an integer, not {seed!r}")
    if not (LOWEST_SEED <= seed <= HIGHEST_SEED and is_prime(seed)):
        raise ValueError(f"{seed} is no prime between {LOWEST_SEED} and {HIGHEST_SEED}")


def seeds(given: list[int], n: int, master: int = 0) -> list[int]:
    """``n`` different seeds: the given ones, in order, then primes of the range drawn with ``master``; longer lists extend shorter ones."""
    import random

    if n < 1:
        raise ValueError("n must be at least 1")
    for s in given:
        check_seed(s)
    more = n - len(given)
    if more <= 0:
        return list(given[:n])
    prime = bytearray([1]) * (HIGHEST_SEED + 1)
    for p in range(2, int(HIGHEST_SEED**0.5) + 1):
        prime[p * p :: p] = bytes(len(range(p * p, HIGHEST_SEED + 1, p)))
    others = [p for p in range(LOWEST_SEED, HIGHEST_SEED + 1) if prime[p] and p not in given]
    return [*given, *random.Random(master).sample(others, more)]


def min_data_for_all_rows(min_data: int, rate: float) -> int:
    """A leaf's minimum tuned on a part ``rate`` of the rows, for all of them; unchanged from rate 1 on, at least 1."""
    return max(1, round(min_data / rate)) if rate < 1 else min_data


def scaled_min_data(min_data: int, rows: int, full_rows: int) -> int:
    """A leaf's minimum rows, scaled to the part of the rows that is used; at least 1."""
    return max(1, round(min_data * rows / full_rows))


def validate_folds(folds: list[dict], target: int, gap: int, available: list[int]) -> None:
    """Raise if a fold uses a month that is absent, or trains closer than ``gap`` to its validation or validates closer than ``gap`` to the target."""
    for f in folds:
        months = [*f["train"], f["valid"]]
        if missing := [m for m in months if m not in available]:
            raise ValueError(f"months without rows: {missing}")
        if max(f["train"]) > offset(f["valid"], -gap) or f["valid"] > offset(target, -gap):
            raise ValueError(f"fold of {f['valid']} leaves no gap of {gap}")


def canaries(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``df`` with random columns ``canarito_1..n`` in [0, 1), the same on every run: what noise looks like to a model."""
    return df.withColumns({f"canarito_{i}": F.pmod(F.xxhash64(*keys, F.lit(seed + i)), F.lit(1_000_003)) / F.lit(1_000_003.0) for i in range(1, n + 1)})


__all__ = ["canaries", "check_seed", "derive_folds", "is_prime", "min_data_for_all_rows", "scaled_min_data", "seeds", "validate_folds"]
