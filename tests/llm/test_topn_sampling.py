import random

from pyspark.sql import functions as F

from cohortex.llm.sampling import Goal, proportional_sample, reservoirs
from cohortex.llm.topn import top_n_banded
from cohortex.operators.ranking import uniform


def ties():
    return [F.col("m").desc_nulls_last(), F.col("i").asc()]


def test_top_n_against_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, *range(1, 150), None]), rng.choice([None, float("nan"), 0.0, 0.0, float(rng.randrange(30))]), rng.choice([None, rng.randrange(4)]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, s double, m long, i long").withColumn("pos", F.lit("x"))
    for first in (None, 1 / 64):
        got = {(r["g"], r["i"], r["place"]) for r in top_n_banded(df, "g", "s", ties(), 3, ["i", "m"], first).collect()}
        want = set()
        for g in {r[0] for r in rows if r[0] is not None}:
            mine = sorted((r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]), key=lambda r: (-r[1], -(r[2] if r[2] is not None else -1), r[3]))
            want |= {(g, r[3], k + 1) for k, r in enumerate(mine[:3])}
        assert got == want


def test_filled_groups_leave_lower_bands(spark, monkeypatch):
    from cohortex.llm import topn

    rows = [(i % 200, float(i), 0, i) for i in range(6000)] + [(777, float(i % 50), 1, 100_000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, s double, m long, i long")
    want = {(g, r[3], k + 1) for g in {r[0] for r in rows} for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], -r[2], r[3]))[:3])}
    for bound in (topn.BROADCAST_ROWS, 0):  # filled groups taken out by a broadcast, then by a shuffled anti-join
        monkeypatch.setattr(topn, "BROADCAST_ROWS", bound)
        staged = []
        monkeypatch.setattr(topn, "stage", lambda d, label, keep=topn.stage: staged.append((label, d)) or keep(d, label))
        assert {(r["g"], r["i"], r["place"]) for r in top_n_banded(df, "g", "s", ties(), 3, ["i", "m"], 1 / 64).collect()} == want
        if bound == 0:
            assert "unfilled" in [label for label, _ in staged]


def test_top_n_edges(spark):
    schema = "g long, s double, m long, i long"
    assert top_n_banded(spark.createDataFrame([], schema), "g", "s", ties(), 3, ["i", "m"]).count() == 0
    same = spark.createDataFrame([(1, 2.0, 1, 1)] * 5, schema)
    assert [r["place"] for r in top_n_banded(same, "g", "s", ties(), 3, ["i", "m"]).orderBy("place").collect()] == [1, 2, 3]


def goals(spark, rows):
    return spark.createDataFrame(rows, "cat string, share double, least int")


def lowest(rows, cat, n, seed=11):
    """The n rows of a category with the lowest priorities, by the driver."""
    return {i for _, i in sorted((u, i) for c, i, u in rows if c == cat)[:n]}


def prioritised(df):
    return [tuple(r) for r in df.select("cat", "id", uniform("id", seed=11).alias("u")).collect()]


def test_sample_meets_quotas_and_reports(spark):
    n = {"a": 5000, "b": 300, "c": 3}
    rows = [(c, i) for i, c in enumerate(c for c, k in n.items() for _ in range(k))] + [(None, 10_000), ("z", 10_001)]
    df = spark.createDataFrame(rows, "cat string, id long").repartition(5).withColumn("seen", F.lit(2)).withColumn("key", F.lit("x"))
    s = proportional_sample(df, "id", "cat", goals(spark, [("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 5), ("d", None, 2), ("e", 0.0, 0), (None, 0.1, 1)]), "share", "least", 0.1)
    got = s.rows.collect()
    total = 5304 // 10
    r = {x["cat"]: x for x in s.report.collect()}
    assert len({x["id"] for x in got}) == len(got) and {x["cat"] for x in got} == {"a", "b", "c"}
    assert sum(x["cat"] == "a" for x in got) == r["a"]["quota"] == total // 2 and r["b"]["quota"] == total // 2
    assert (r["c"]["quota"], r["c"]["met"], r["c"]["available"]) == (3, False, 3) and (r["d"]["met"], r["e"]["met"]) == (False, True)
    again = proportional_sample(df.repartition(2), "id", "cat", goals(spark, [("a", 0.5, 1), ("b", 0.5, 1), ("c", 0.0, 5)]), "share", "least", 0.1)
    assert {x["id"] for x in again.rows.collect()} == {x["id"] for x in got} == {i for c in "abc" for i in lowest(prioritised(df), c, r[c]["quota"])}
    even = {x["cat"]: x for x in proportional_sample(df, "id", "cat", goals(spark, [("a", 0.9, 1), ("b", 0.1, 1), ("c", 0.02, 1), ("d", 0.5, 2)]), "share", "least", 0.1, keep_shares=True).report.collect()}
    assert [even[c]["quota"] for c in "abcd"] == [135, 15, 3, 0] and not even["c"]["met"]


def test_sample_is_even_and_thin(spark):
    df = spark.range(0, 120_000, 1, 3).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("cat"), "id")
    wanted = [("a", 0.98, 1), ("b", 0.02, 5)]
    s = proportional_sample(df, "id", "cat", goals(spark, wanted), "share", "least", 0.1)
    ids = [(r["cat"], r["id"]) for r in s.rows.collect()]
    a = [i for c, i in ids if c == "a"]
    assert len(a) == 11_760 and len(ids) == 12_000 and abs(sum(a) / len(a) - 60_000) < 1_500
    rows = prioritised(df)
    assert set(a) == lowest(rows, "a", 11_760) and {i for c, i in ids if c == "b"} == lowest(rows, "b", 240)
    pool = reservoirs(df, "cat", "id", {"a": Goal(0.98, 1), "b": Goal(0.02, 5)}, 0.1, 11).where("seen is null")
    assert pool.count() < 50_000  # a task's first batches are kept whole, later ones to about the share wanted


def test_sample_where_tasks_differ(spark):
    """Every task sees one category only, so thresholds fall too low and the reservoirs are filled in a second pass."""
    df = spark.range(0, 90_000, 1, 3).select(F.expr("case when id < 30000 then 'a' when id < 60000 then 'b' else 'c' end").alias("cat"), "id")
    s = proportional_sample(df, "id", "cat", goals(spark, [("a", 0.9, 1), ("b", 0.1, 20), ("c", 0.0, 7)]), "share", "least", 0.1)
    got = {}
    for r in s.rows.collect():
        got.setdefault(r["cat"], set()).add(r["id"])
    rows = prioritised(df)
    assert got == {"a": lowest(rows, "a", 8100), "b": lowest(rows, "b", 900), "c": lowest(rows, "c", 7)}


def test_sample_edges(spark):
    df = spark.createDataFrame([], "cat string, id long")
    empty = proportional_sample(df, "id", "cat", goals(spark, [("a", 1.0, 1)]), "share", "least", 0.1)
    assert empty.rows.count() == 0 and not empty.report.first()["met"]
    none = proportional_sample(spark.range(50).select(F.lit("a").alias("cat"), "id"), "id", "cat", goals(spark, []), "share", "least", 0.1)
    assert none.rows.count() == 0 == none.report.count()
