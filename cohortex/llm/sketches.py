"""Percentiles from dyadic Count-sketches that add up over loads and take deletions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortex.staging import stage

SKETCH = "grp string, field string, n long, cells binary"


@dataclass(frozen=True)
class Layout:
    """Shape of a sketch.  Sketches add up only if their layouts are equal.

    bits: resolution of the value code.  32 keeps sign, exponent and 20 bits of
    the fraction, so a returned value is within 2**-20 of a true one, relatively.
    exact: prefixes of up to this many bits are counted exactly; longer
    ones through ``depth`` signed rows of ``width`` counters each.

    Error: the rank of a percentile is off by the sum of the errors at the
    levels below ``exact``.  One level's estimate is off by more than
    3 * |f|_2 / sqrt(width) with probability below 2 * 0.16 ** ((depth + 1) / 2),
    f being the counts of the level's prefixes; ``rank_error`` is the stated
    bound for the sum, held by the tests against sorted values.
    """

    bits: int = 32
    exact: int = 11
    depth: int = 5
    width: int = 512
    rank_error: float = 0.01

    @property
    def size(self) -> int:
        return (1 << (self.exact + 1)) + (self.bits - self.exact) * self.depth * self.width


def encode(x: np.ndarray, bits: int) -> np.ndarray:
    """Order-preserving integer codes of float64 values, the top ``bits`` bits."""
    raw = np.ascontiguousarray(x + 0.0, dtype=np.float64).view(np.uint64)  # + 0.0: -0.0 becomes 0.0
    flip = np.where(raw >> np.uint64(63) == 1, ~np.uint64(0), np.uint64(1) << np.uint64(63))
    return (raw ^ flip) >> np.uint64(64 - bits)


def decode(code: np.ndarray, bits: int, part: str = "mid") -> np.ndarray:
    """The lowest (``lo``), middle or highest (``hi``) value of each code's range."""
    low = (1 << (64 - bits)) - 1
    c = np.asarray(code, dtype=np.uint64) << np.uint64(64 - bits) | np.uint64({"lo": 0, "mid": (low + 1) // 2, "hi": low}[part])
    raw = np.where(c >> np.uint64(63) == 1, c ^ (np.uint64(1) << np.uint64(63)), ~c)
    return np.ascontiguousarray(raw).view(np.float64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64's finaliser on x + salt * golden ratio."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _cells(codes: np.ndarray, lay: Layout) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For every level the cell indices of ``codes`` and their signs (None: all +1)."""
    for level in range(lay.exact + 1):
        yield (1 << level) + (codes >> np.uint64(lay.bits - level)).astype(np.int64), None
    base = 1 << (lay.exact + 1)
    for level in range(lay.exact + 1, lay.bits + 1):
        prefix = codes >> np.uint64(lay.bits - level)
        for row in range(lay.depth):
            h = _mix(prefix, level * 64 + row + 1)
            yield base + (h >> np.uint64(1)).astype(np.int64) % lay.width, 1 - 2 * (h & np.uint64(1)).astype(np.int64)
            base += lay.width


def add_values(sketch: np.ndarray, x: np.ndarray, lay: Layout, weight: np.ndarray | int = 1) -> None:
    """Add finite values to a sketch in place; negative weights delete."""
    codes, inverse = np.unique(encode(x, lay.bits), return_inverse=True)
    w = np.bincount(inverse, weights=np.broadcast_to(weight, x.shape), minlength=len(codes)).astype(np.int64)
    for at, sign in _cells(codes, lay):
        hit = np.bincount(at - at.min(), weights=w if sign is None else w * sign) if len(at) else np.zeros(0)
        lo = int(at.min()) if len(at) else 0
        sketch[lo : lo + len(hit)] += hit.astype(np.int64)


def _count(sketch: np.ndarray, prefix: int, level: int, lay: Layout) -> float:
    """Estimated number of values whose code starts with ``prefix``."""
    if level <= lay.exact:
        return float(sketch[(1 << level) + prefix])
    base = (1 << (lay.exact + 1)) + (level - lay.exact - 1) * lay.depth * lay.width
    p = np.array([prefix], dtype=np.uint64)
    got = []
    for row in range(lay.depth):
        h = int(_mix(p, level * 64 + row + 1)[0])
        got.append((1 - 2 * (h & 1)) * sketch[base + row * lay.width + (h >> 1) % lay.width])
    return float(np.median(got))


def invert(sketch: np.ndarray, n: int, rank: float, lay: Layout, part: str = "mid") -> float:
    """The value of 1-based ``rank``: at each level go left if the left half holds the rank, else right with the rest."""
    prefix, rest, parent = 0, rank, float(n)
    for level in range(1, lay.bits + 1):
        left = min(max(_count(sketch, 2 * prefix, level, lay), 0.0), parent)
        if rest <= left:
            prefix, parent = 2 * prefix, left
        else:
            prefix, rest, parent = 2 * prefix + 1, rest - left, max(parent - left, 0.0)
    value = float(decode(np.array([prefix]), lay.bits, part)[0])
    return 0.0 if part == "mid" and abs(value) < 1e-300 else value  # the middle of the code that starts with zero


def _pack(s: np.ndarray) -> bytes:
    """Non-zero cells only: their number, places (int32) and counts (int64)."""
    at = np.flatnonzero(s).astype(np.int32)
    return np.int64(len(at)).tobytes() + at.tobytes() + s[at].tobytes()


def _unpack_into(s: np.ndarray, b: bytes, sign: int = 1) -> None:
    k = int(np.frombuffer(b, np.int64, 1)[0])
    at = np.frombuffer(b, np.int32, k, 8)
    s[at] += sign * np.frombuffer(b, np.int64, k, 8 + 4 * k)


HELD_CELLS = 24_000_000

#: Values a task gathers before it adds them: every addition passes over all levels and rows of a sketch.
HELD_VALUES = 1_000_000


def sketch_fields(df: DataFrame, group: str, fields: list[str], lay: Layout = Layout(), weight: str | None = None) -> DataFrame:
    """One sketch per group and field: ``grp, field, n, cells`` (grp: the group as string, null groups as null).

    Null, NaN and infinite values are left out.  ``weight``: an integer column;
    -1 deletes a row that an earlier load added.  Sketches are built map-side
    and only they are shuffled, whatever the number of rows; with very many
    groups a task hands on what it holds whenever it holds HELD_CELLS cells.
    """
    cols = [F.col(group).cast("string").alias("grp"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(fields)]]
    cols.append((F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        waiting: dict[tuple, list] = {}
        n = 0
        for batch in batches:
            for g, part in batch.groupby("grp", sort=False, dropna=False):
                g = None if pd.isna(g) else g
                w = part["w"].to_numpy()
                for i, f in enumerate(fields):
                    x = part[f"f{i}"].to_numpy(dtype=np.float64)
                    ok = np.isfinite(x)
                    if ok.any():
                        waiting.setdefault((g, f), []).append((x[ok], w[ok]))
                        n += int(ok.sum())
            if n >= HELD_VALUES:
                yield from _add_waiting(held, waiting, lay)
                n = 0
        yield from _add_waiting(held, waiting, lay)
        if held:
            yield _frame(held)

    return merge_sketches(df.select(*cols).mapInPandas(build, SKETCH), lay)


def _add_waiting(held: dict, waiting: dict, lay: Layout) -> Iterator[pd.DataFrame]:
    """Move all waiting values into their sketches; hand the sketches on whenever they hold HELD_CELLS cells."""
    for k in list(waiting):
        xs, ws = zip(*waiting.pop(k))
        x, w = np.concatenate(xs), np.concatenate(ws)
        s = held.setdefault(k, [0, np.zeros(lay.size, np.int64)])
        add_values(s[1], x, lay, w)
        s[0] += int(w.sum())
        if len(held) * lay.size > HELD_CELLS:
            yield _frame(held)
            held.clear()


def _frame(held: dict) -> pd.DataFrame:
    return pd.DataFrame([(g, f, n, _pack(s)) for (g, f), (n, s) in held.items()], columns=["grp", "field", "n", "cells"])


def merge_sketches(parts: DataFrame, lay: Layout = Layout(), fan: int = 16) -> DataFrame:
    """Sum the sketches of equal group and field; union days or loads first.

    Two rounds, so that a group with a part from every task is summed by
    ``fan`` tasks before one; a task streams its parts and holds sums only.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for g, f, n, b in batch[["grp", "field", "n", "cells"]].itertuples(index=False):
                g = None if pd.isna(g) else g
                s = held.setdefault((g, f), [0, np.zeros(lay.size, np.int64)])
                _unpack_into(s[1], b)
                s[0] += int(n)
        for k in list(held):
            yield _frame({k: held.pop(k)})

    first = parts.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(fan))).repartition("grp", "field", "salt").drop("salt").mapInPandas(add, SKETCH)
    return first.repartition("grp", "field").mapInPandas(add, SKETCH)


def subtract_sketches(whole: DataFrame, part: DataFrame, lay: Layout = Layout()) -> DataFrame:
    """``whole`` without what ``part`` holds."""

    def negate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, f, n, b in batch[["grp", "field", "n", "cells"]].itertuples(index=False):
                s = np.zeros(lay.size, np.int64)
                _unpack_into(s, b, -1)
                yield _frame({(g, f): [-int(n), s]})

    return merge_sketches(whole.unionByName(part.mapInPandas(negate, SKETCH)), lay)


def percentiles(sketches: DataFrame, ps: list[float], lay: Layout = Layout()) -> DataFrame:
    """``grp, field, p, n, value`` and ``lo, hi``: the values at the ranks ``rank_error`` * n below and above.

    The rank of p is p * (n - 1) + 1.  A field without values has no row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, f, n, b in batch[["grp", "field", "n", "cells"]].itertuples(index=False):
                if n <= 0:
                    continue
                s = np.zeros(lay.size, np.int64)
                _unpack_into(s, b)
                slack = lay.rank_error * n + 1
                for p in ps:
                    r = p * (n - 1) + 1
                    out.append((g, f, p, n, invert(s, n, r, lay), invert(s, n, max(1.0, r - slack), lay, "lo"), invert(s, n, min(float(n), r + slack), lay, "hi")))
            yield pd.DataFrame(out, columns=["grp", "field", "p", "n", "value", "lo", "hi"])

    return sketches.mapInPandas(read, "grp string, field string, p double, n long, value double, lo double, hi double")


BINS = 4096

#: Values of a group and field that may be ordered one by one; more are narrowed down first.
FEW = 50_000


def _long(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """``grp, field, x`` of all finite values."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    long = df.select(F.col(group).cast("string").alias("grp"), F.explode(parts).alias("v")).select("grp", "v.*")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))


def _with(long: DataFrame, small: DataFrame) -> DataFrame:
    """``long`` with the row of ``small`` (keys ``bg, bf``) of its group and field, for those that have one; broadcast only when counted and small."""
    b = F.broadcast(small) if small.count() <= 50_000 else small
    return long.join(b, F.col("grp").eqNullSafe(F.col("bg")) & (F.col("field") == F.col("bf"))).drop("bg", "bf")


def _narrow(long: DataFrame, brackets: DataFrame) -> DataFrame:
    """``bg, bf, lo, hi, n, below, inside``: the values' range that holds the middle places, how many values lie below it and in it.

    The values below each bracket, above it, and in each of BINS parts of it
    (equal ones, or of equal ratio where the bracket spans orders of magnitude)
    are counted map-side; the parts that hold the middle places make the new
    range, whether the bracket held them or not.
    """
    scaled = lambda c: F.when(F.col("wide"), F.signum(c) * F.log1p(F.abs(c))).otherwise(F.col(c))  # noqa: E731  (never decreasing)
    wide = F.col("hi") - F.col("lo") > 1e3 * (1 + F.least(F.abs("lo"), F.abs("hi")))
    j = _with(long, brackets.select("bg", "bf", "lo", "hi").withColumn("wide", wide))
    place = F.coalesce(F.floor(F.try_divide(scaled("x") - scaled("lo"), scaled("hi") - scaled("lo")) * BINS), F.lit(0))
    part = F.when(F.col("x") < F.col("lo"), F.lit(-1)).when(F.col("x") > F.col("hi"), F.lit(BINS)).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(BINS - 1)))).cast("int")
    counts = j.groupBy("grp", "field", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("first"), F.max("x").alias("last"))
    whole = Window.partitionBy("grp", "field")  # at most BINS + 2 rows
    upto = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    r = counts.select("*", F.sum("c").over(whole).alias("n"), upto.alias("upto"))
    k1, k2 = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    at = lambda k: (F.col("upto") - F.col("c") < k) & (k <= F.col("upto"))
    pick = lambda k, c: F.max(F.when(at(k), c))
    return r.groupBy(F.col("grp").alias("bg"), F.col("field").alias("bf")).agg(
        pick(k1, F.col("first")).alias("lo"), pick(k2, F.col("last")).alias("hi"), F.max("n").alias("n"), pick(k1, F.col("upto") - F.col("c")).alias("below"), (pick(k2, F.col("upto")) - pick(k1, F.col("upto") - F.col("c"))).alias("inside")
    )


def exact_medians(df: DataFrame, group: str, fields: list[str], brackets: DataFrame) -> DataFrame:
    """Exact medians of the groups and fields of ``brackets`` (``grp, field, lo, hi``, from ``percentiles`` for p = 0.5): ``grp, field, n, median``.

    ``df`` is read once a step, stage it.  The brackets are narrowed down until
    at most FEW values (or copies of one value) of a group and field are left,
    which takes one step where a sketch's bracket is right, and some more where
    it is not or where values heap up; only those few are ordered one by one.
    So no task orders a whole group, however its values lie.
    """
    long = _long(df, group, fields)
    todo = brackets.select(F.col("grp").alias("bg"), F.col("field").alias("bf"), "lo", "hi")
    ready = None
    for _ in range(100):
        step = stage(_narrow(long, todo), "middle")
        done = (F.col("inside") <= FEW) | (F.col("lo") == F.col("hi"))
        ready = step.where(done) if ready is None else ready.unionByName(step.where(done))
        todo = step.where(~done)
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("medians were not narrowed down in 100 steps")
    few = _with(long, stage(ready.drop("inside"), "ready")).where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy("grp", "field", "x").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("below").alias("below"))
    upto = F.sum("c").over(Window.partitionBy("grp", "field").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # at most FEW rows
    v = few.select("*", (upto + F.col("below")).alias("upto"))
    at = lambda k: F.max(F.when((F.col("upto") - F.col("c") < k) & (k <= F.col("upto")), F.col("x")))
    k1, k2 = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return v.groupBy("grp", "field").agg(F.max("n").alias("n"), ((at(k1) + at(k2)) / 2).alias("median"))


def medians(df: DataFrame, group: str, fields: list[str], lay: Layout = Layout()) -> DataFrame:
    """Exact medians of ``fields`` per group: ``grp, field, n, median``; stage ``df``.  The sketches give brackets, the exact check reads the medians from them."""
    return exact_medians(df, group, fields, stage(percentiles(sketch_fields(df, group, fields, lay), [0.5], lay), "brackets"))


def _change(m, p, ratio: float):
    """How far |m - p| is above ``ratio`` * |p|."""
    return F.abs(m - p) - ratio * F.abs(p)


def median_jumps(df: DataFrame, group: str, fields: list[str], ratio: float, lay: Layout = Layout()) -> DataFrame:
    """``group, field`` of the medians that differ from the median of the preceding group by more than ``ratio`` times its absolute value.

    group: an integer column; the preceding group is the one before in order
    among those that have rows.  Where either has no value there is no jump.

    The sketches decide: a median lies in the bracket of its stated rank error,
    and where all medians in the two brackets jump, or none does, that is the
    answer.  Only pairs of groups that the brackets leave open are measured
    exactly, by ``exact_medians``.  Stage ``df``.
    """
    brackets = stage(percentiles(sketch_fields(df, group, fields, lay), [0.5], lay), "brackets")
    groups = df.select(F.col(group).cast("string").alias("grp")).where("grp is not null").distinct()
    every = groups.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))

    def paired(t: DataFrame, *columns: str) -> DataFrame:
        before = Window.partitionBy("field").orderBy(F.col("grp").cast("long"))  # one row a group
        j = every.join(t.select("grp", "field", *columns), ["grp", "field"], "left")
        return j.select("*", F.lag("grp").over(before).alias("p_grp"), *[F.lag(c).over(before).alias(f"p_{c}") for c in columns])

    b = paired(brackets, "lo", "hi").where("lo is not null and p_lo is not null")
    clamp = lambda x, lo, hi: F.greatest(F.col(lo), F.least(F.col(hi), x))
    # the change is linear between these points, so its extremes over both brackets are among them
    ps = [F.col("p_lo"), F.col("p_hi"), clamp(F.lit(0.0), "p_lo", "p_hi"), clamp(F.col("lo"), "p_lo", "p_hi"), clamp(F.col("hi"), "p_lo", "p_hi")]
    all_ = [_change(m, p, ratio) for p in ps for m in (F.col("lo"), F.col("hi"), clamp(p, "lo", "hi"))]
    judged = stage(b.select("grp", "p_grp", "field", (F.least(*all_) > 0).alias("surely"), (F.greatest(*all_) > 0).alias("maybe")), "judged")
    sure = judged.where("surely").select("grp", "field")
    unclear = judged.where("maybe and not surely")
    if not unclear.isEmpty():
        need = unclear.select("grp", "field").unionByName(unclear.select(F.col("p_grp").alias("grp"), "field")).distinct()
        exact = exact_medians(df, group, fields, brackets.join(need, ["grp", "field"]))
        open_ = paired(exact, "median").join(unclear.select("grp", "field"), ["grp", "field"], "left_semi")
        sure = sure.unionByName(open_.where(_change(F.col("median"), F.col("p_median"), ratio) > 0).select("grp", "field"))
    return sure.select(F.col("grp").cast(dict(df.dtypes)[group]).alias(group), "field")
