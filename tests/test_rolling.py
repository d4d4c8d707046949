import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortex.operators.latest import latest_rows
from cohortex.operators.rolling import rolling_totals

SCHEMA = "e long, t int, a double, b long"


def month(i):
    return i // 12 * 100 + i % 12 + 1


def brute(rows, windows):
    by = {}
    for e, t, a, b in rows:
        if e is None or t is None or not 1 <= t % 100 <= 12:
            continue
        i = t // 100 * 12 + t % 100 - 1
        a = 0 if a is None or a != a or abs(a) == float("inf") else Decimal(str(a))
        s = by.setdefault(e, {}).setdefault(i, [Decimal(0), 0])
        s[0] += a
        s[1] += b or 0
    out = {}
    for e, m in by.items():
        for i in range(min(m), max(m) + 1):
            out[e, month(i)] = [sum(m.get(j, [0, 0])[k] for j in range(i - w + 1, i + 1)) for k in (0, 1) for w in windows]
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), month(24240 + rng.randrange(20)), rng.choice([None, 0.0, float("nan"), float("inf"), round(rng.uniform(-500, 500), 2)]), rng.choice([None, 0, rng.randrange(9)])) for _ in range(300)]
    rows += rows[:20] + [(1, None, 1.0, 1), (1, 202113, 1.0, 1)]
    got = rolling_totals(spark.createDataFrame(rows, SCHEMA), "e", "t", ["a", "b"], [3, 6]).collect()
    want = brute(rows, [3, 6])
    assert {(r["e"], r["t"]) for r in got} == set(want)
    for r in got:
        assert [r["a_total_3"], r["a_total_6"], r["b_total_3"], r["b_total_6"]] == want[r["e"], r["t"]]
        assert r["a_avg_3"] == pytest.approx(float(r["a_total_3"]) / 3)


def test_what_was_added_is_taken_away_exactly(spark):
    rows = [(1, 202001, 0.1, 1), (1, 202002, 0.2, 1), (1, 202003, -0.3, 1), (1, 202012, 1e12, 0)]
    got = {r["t"]: r["a_total_3"] for r in rolling_totals(spark.createDataFrame(rows, SCHEMA), "e", "t", ["a"], [3]).collect()}
    assert got[202003] == 0 and got[202006] == 0 and got[202012] == Decimal("1000000000000") and len(got) == 12


def test_days_and_plain_numbers(spark):
    d = spark.createDataFrame([("x", dt.datetime(2024, 2, 28, 23), 1.0), ("x", dt.datetime(2024, 3, 1, 1), 2.0)], "who string, at timestamp, v double")
    got = {str(r["at"]): float(r["v_total_2"]) for r in rolling_totals(d, "who", "at", ["v"], [2], calendar="day").collect()}
    assert got == {"2024-02-28": 1.0, "2024-02-29": 1.0, "2024-03-01": 2.0}
    n = rolling_totals(spark.createDataFrame([(1, 5, 1.0, 1)], SCHEMA), "e", "t", ["a"], [1], calendar="int").collect()
    assert [(r["t"], float(r["a_total_1"])) for r in n] == [(5, 1.0)]


def test_empty_and_clashing_names(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA), "e", "t", ["a"], [3]).count() == 0
    odd = spark.createDataFrame([(1, 202001, 2.0, 9, 9, 9)], "e long, t int, at double, next long, last long, d0_3 long")
    assert float(rolling_totals(odd, "e", "t", ["at"], [3]).first()["at_total_3"]) == 2.0
    with pytest.raises(ValueError):
        rolling_totals(odd, "e", "t", ["at"], [0])


def test_one_shuffle_by_entity_after_the_sums(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("e"), (F.col("id") % 12 + 202001).cast("int").alias("t"), F.lit(1.0).alias("a"))
    plan = rolling_totals(big, "e", "t", ["a"], [3])._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2


def test_latest_rows(spark):
    rows = [(1, 5, 1), (1, 7, 2), (1, 7, 3), (2, None, 4), (None, 1, 5), (3, None, 6), (3, 1, 7)]
    got = latest_rows(spark.createDataFrame(rows, "k long, v long, i long"), "k", "v", "i").collect()
    assert {(r["k"], r["i"]) for r in got} == {(1, 3), (2, 4), (3, 7)}
