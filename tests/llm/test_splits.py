import random

import pytest

from cohortex.llm.components import connected_components
from cohortex.llm.splits import leaking_entities, plan_splits, split_records

SHARES = {"train": 0.7, "valid": 0.15, "test": 0.15}


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500), (None, 1), (2, None)]
    edges += [(b, a) for a, b in edges[:10]] + [(900, i) for i in range(700, 760)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == union_find(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_best(sizes, target):
    sums = {0}
    for s, m in sizes.items():
        for _ in range(m):
            sums |= {t + s for t in sums}
    return min(abs(t - target) for t in sums)


def test_plan_comes_as_close_as_possible():
    for sizes in ({1: 3, 5: 2, 40: 1}, {7: 9}, {100: 1}, {3: 4, 11: 3, 2: 1}, {}):
        total = sum(s * m for s, m in sizes.items())
        plan = plan_splits(sizes, SHARES)
        for s, m in sizes.items():
            assert sum(plan[k].get(s, 0) for k in plan) == m and min(plan[k].get(s, 0) for k in plan) >= 0
        got = sum(s * m for s, m in plan["test"].items())
        assert abs(got - total * 0.15) == pytest.approx(brute_best(sizes, total * 0.15))
    big = plan_splits({1: 10_000_000, 14: 3_000_000, 5_000_000: 1}, SHARES, max_bits=1 << 20)
    total = 10_000_000 + 42_000_000 + 5_000_000
    for k, share in SHARES.items():
        assert abs(sum(s * m for s, m in big[k].items()) / total - share) < 1e-3
    with pytest.raises(ValueError):
        plan_splits({1: 1}, {"a": -1.0, "b": 2.0})


@pytest.mark.parametrize("seed", range(8))
def test_plan_against_all_sums(seed):
    rng = random.Random(seed)
    sizes = {rng.randrange(1, 400): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
    total = sum(s * m for s, m in sizes.items())
    plan = plan_splits(sizes, {"a": 0.1, "b": 0.9})
    bits = 1
    for s, m in sizes.items():
        for _ in range(m):
            bits |= bits << s
    got = sum(s * m for s, m in plan["a"].items())
    assert abs(got - total * 0.1) == pytest.approx(min(abs(t - total * 0.1) for t in range(total + 1) if bits >> t & 1))
    assert all(plan["a"].get(s, 0) + plan["b"].get(s, 0) == m for s, m in sizes.items())


def test_plan_keeps_few_bitsets():
    import tracemalloc

    sizes = dict.fromkeys(range(1, 1449), 1)  # as many sizes as 2**20 records can have; each bitset is up to 40 kB
    tracemalloc.start()
    plan = plan_splits(sizes, SHARES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total = sum(sizes)
    assert all(abs(sum(s * m for s, m in plan[k].items()) - total * SHARES[k]) < 1 for k in SHARES)
    assert peak < 12_000_000


def records(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, *range(2, 60)]), rng.choice(["train", " TRAIN", "test", None, " "]), i) for i in range(900)] + [(None, "test", 1)]
    return spark.createDataFrame(rows, "who long, part string, n long"), rows


def test_one_person_one_split(spark):
    df, rows = records(spark)
    links = [(3, 4), (4, 70), (70, 5), (9, 9), (8, None), (6, 7), (7, 6)]
    got = split_records(df, "who", spark.createDataFrame(links, "a long, b long"), "a", "b", SHARES).collect()
    assert {r["who"] for r in got} == {w for w, _, _ in rows if w is not None} and len(got) == len({r["who"] for r in got})
    by = {}
    for r in got:
        assert by.setdefault(r["person"], r["split"]) == r["split"]
    assert len({r["person"] for r in got if r["who"] in (3, 4, 5)}) == 1
    n = {k: sum(r["n"] for r in got if r["split"] == k) for k in SHARES}
    assert all(abs(n[k] - 900 * SHARES[k]) <= 1 for k in SHARES)
    again = split_records(df.repartition(5), "who", spark.createDataFrame(links, "a long, b long"), "a", "b", SHARES).collect()
    assert {(r["who"], r["split"]) for r in again} == {(r["who"], r["split"]) for r in got}
    assert split_records(df.limit(0), "who", spark.createDataFrame([], "a long, b long"), "a", "b", SHARES).count() == 0


def test_leaks_between_splits(spark):
    rows = [(1, "train"), (1, " Train "), (2, "test"), (3, None), (4, "valid"), (5, "train"), (5, "test"), (None, "test")]
    got = leaking_entities(spark.createDataFrame(rows, "who long, part string"), "who", "part", spark.createDataFrame([(1, 99), (99, 2), (3, 4)], "a long, b long"), "a", "b")
    assert {r["who"] for r in got.collect()} == {1, 2, 5}


@pytest.mark.parametrize("seed", range(12))
def test_plan_of_many_records_is_as_close_as_one_of_few(seed):
    """Totals far above 2**24 with few sizes, against all sums: reachable by residues of the smallest size."""
    rng = random.Random(seed)
    unit = rng.randrange(3, 60)
    sizes = {unit: 40_000_000 // unit} | {rng.randrange(unit + 1, 4000): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
    total = sum(s * m for s, m in sizes.items())
    goal = total * 0.15
    others = {0}
    for s, m in sizes.items():
        if s != unit:
            others = {t + s * n for t in others for n in range(m + 1)}
    best = min(abs(o + unit * k - goal) for o in others for k in (int((goal - o) // unit), int((goal - o) // unit) + 1))
    plan = plan_splits(sizes, {"a": 0.15, "b": 0.85})
    assert abs(sum(s * m for s, m in plan["a"].items()) - goal) == best
    assert all(plan["a"].get(s, 0) + plan["b"].get(s, 0) == m for s, m in sizes.items())


def test_plan_of_huge_tables_has_no_gap():
    sizes = {s: 10**11 // s**2 for s in range(1, 5000, 7)} | {3 * 10**9: 1}
    total = sum(s * m for s, m in sizes.items())
    plan = plan_splits(sizes, SHARES)
    assert all(abs(sum(s * m for s, m in plan[k].items()) - total * SHARES[k]) <= 1 for k in SHARES)


@pytest.mark.parametrize("bits", [1, 64, 1 << 24])
def test_first_width_does_not_change_how_close_a_plan_is(bits):
    for sizes in ({6: 5, 10: 3, 15: 1}, {9: 100, 12: 40, 1000: 2, 4: 1}, {31: 7, 32: 7, 500: 1}):
        plan = plan_splits(sizes, {"a": 0.3, "b": 0.7}, max_bits=bits)
        goal = 0.3 * sum(s * m for s, m in sizes.items())
        assert abs(sum(s * m for s, m in plan["a"].items()) - goal) == pytest.approx(brute_best(sizes, goal))


def test_few_groups_off_the_common_divisor():
    sizes = {1000 * i: 3 for i in range(1, 3000)} | {777: 1}
    goal = 0.15 * sum(s * m for s, m in sizes.items())
    plan = plan_splits(sizes, {"a": 0.15, "b": 0.85})
    assert abs(sum(s * m for s, m in plan["a"].items()) - goal) == min(abs(goal - o - 1000 * round((goal - o) / 1000)) for o in (0, 777))
