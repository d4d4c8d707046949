import random

import pytest
from pyspark.sql import functions as F

from cohortex.operators import cohort, drift, ml, stats
from cohortex.operators.planning import canaries, is_prime, min_data_for_all_rows, scaled_min_data, seeds, validate_folds
from cohortex.operators.ranking import quantiles
from cohortex.sources.trials import TrialStore

FIELDS = ["a", "b"]


def data(spark, n=600):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        y = rng.random() < 0.4
        rows.append((i, rng.gauss(3 if y else 0, 1), None if i % 50 == 0 else rng.gauss(0, 1), y))
    return spark.createDataFrame(rows, "id long, a double, b double, y boolean")


def test_models_find_the_signal(spark):
    d = ml.impute(data(spark), FIELDS)
    assert d.where("b is null").count() == 0
    m = ml.fit_classifier(ml.class_weights(d, "id", {}), FIELDS, F.col("y"), "forest", "weight", trees=6, depth=3)
    imp = {r["feature"]: r["importance"] for r in ml.importance(m, FIELDS, spark).collect()}
    assert imp["a"] > 0.8
    p = ml.leaf_profiles(m, d, ["id"], FIELDS).collect()
    assert all(abs(r["a"] + r["b"] - 1) < 1e-9 for r in p) and sum(r["a"] for r in p) > sum(r["b"] for r in p)
    g = ml.grid_search(d.where("id < 400"), d.where("id >= 400"), FIELDS, F.col("y"), [{"depth": 2}, {"depth": 3}], "tree").collect()
    assert len(g) == 2 and all(r["auc"] > 0.8 for r in g)


def test_cluster_quality(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(20 * (i % 3), 1), rng.gauss(-20 * (i % 3), 1)) for i in range(300)]
    k = ml.kmeans_profiles(spark.createDataFrame(rows, "id long, a double, b double"), ["id"], FIELDS, 3)
    q = ml.cluster_quality(k, "cluster", FIELDS).first()
    assert q["clusters"] == 3 and q["n"] == 300 and q["calinski_harabasz"] > 1000 and q["size_ratio"] == 1.0
    assert ml.silhouette(k, "cluster", FIELDS) > 0.9


def test_planning(spark):
    assert [is_prime(x) for x in (1, 2, 9, 104729)] == [False, True, False, True]
    drawn = seeds([104729, 100003], 6, 3)
    assert drawn[:2] == [104729, 100003] and len(set(drawn)) == 6 and all(is_prime(p) and 100_003 <= p <= 999_983 for p in drawn)
    assert drawn == seeds([104729, 100003], 6, 3) != seeds([104729, 100003], 6, 4) and seeds([104729, 100003], 1) == [104729]
    for bad in ([8], [7], [104730]):
        with pytest.raises(ValueError):
            seeds(bad, 2)
    assert min_data_for_all_rows(20, 0.1) == 200 and min_data_for_all_rows(20, 1.0) == 20 and min_data_for_all_rows(0, 0.5) == 1
    assert scaled_min_data(1000, 10, 100) == 100 and scaled_min_data(1, 1, 100) == 1
    validate_folds([{"valid": 202106, "train": [202103, 202104]}], 202108, 2, [202103, 202104, 202106])
    for folds in ([{"valid": 202107, "train": [202103]}], [{"valid": 202106, "train": [202105]}], [{"valid": 202106, "train": [202001]}]):
        with pytest.raises(ValueError):
            validate_folds(folds, 202108, 2, [202103, 202105, 202106, 202107])
    c = canaries(spark.range(2000), ["id"], 3, 1)
    assert c.agg(F.avg("canarito_1")).first()[0] == pytest.approx(0.5, abs=0.03)
    assert c.collect() == canaries(spark.range(2000), ["id"], 3, 1).collect() != canaries(spark.range(2000), ["id"], 3, 2).collect()


def test_empty_and_null_statistics(spark):
    d = spark.createDataFrame([(1, 1.0, True), (2, None, False), (3, 3.0, None)], "id long, x double, y boolean")
    assert stats.spearman(d, "x", "id").first()["n"] == 2
    assert stats.chi_square(d.limit(0), "x", "id").count() == 1
    p = drift.psi_table(spark.createDataFrame([(1, None), (2, None)], "g int, x double"), "g", 1, 2, "x").collect()
    assert [(r["bin"], r["term"]) for r in p] == [(-1, 0.0)]
    assert cohort.population_percentile(d.limit(0), "x", [1.0]).first()["pct"] == 50.0
    assert stats.normal_p(0) == 1.0


def test_quantiles_exact_and_merged(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, 0.0, rng.gauss(0, 10), float(rng.randrange(5)), None])) for g in ("a", "a", "b", None) for _ in range(500)] + [("void", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    import numpy as np

    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    exact = {r["g"]: r["q"] for r in quantiles(d, ["g"], "x", ps, None).collect()}
    merged = {r["g"]: r["q"] for r in quantiles(d, ["g"], "x", ps).collect()}
    assert set(exact) == set(merged) == {"a", "b", None}
    for g in exact:
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert exact[g] == pytest.approx(list(np.quantile(xs, ps)))
        assert all(abs(np.searchsorted(xs, v, "left") - p * len(xs)) <= 2 or xs[min(len(xs) - 1, int(p * len(xs)))] == v for v, p in zip(merged[g], ps))
    assert quantiles(d.limit(0), ["g"], "x", ps, None).count() == 0 == quantiles(d.limit(0), [], "x", ps, None).count()


def test_davies_bouldin_and_modes(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(i % 3, rng.gauss(5 * (i % 3), 1), rng.gauss(0, 1)) for i in range(90)]
    x, c = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    centres = np.array([x[c == k].mean(0) for k in range(3)])
    s = np.array([np.linalg.norm(x[c == k] - centres[k], axis=1).mean() for k in range(3)])
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)])
    got = ml.davies_bouldin(spark.createDataFrame(rows, "cluster int, a double, b double"), "cluster", FIELDS).first()
    assert got["clusters"] == 3 and got["davies_bouldin"] == pytest.approx(want)
    m = ml.impute_modes(spark.createDataFrame([("x", None), ("x", "p"), (None, "q"), ("y", None)], "a string, b string"), ["a", "b"]).collect()
    assert [tuple(r) for r in m] == [("x", "p"), ("x", "p"), ("x", "q"), ("y", "p")]


def test_search_is_taken_up_again(spark, tmp_path):
    d = ml.impute(data(spark, 300), FIELDS)
    folds = [(d.where("id % 3 <> 0"), d.where("id % 3 = 0"))]
    store = TrialStore(spark, f"file://{tmp_path}/trials")
    space = {"depth": (1, 4), "leaf_rows": [1, 20]}
    two = ml.random_search(folds, FIELDS, F.col("y"), space, 2, 5, "tree", store).collect()
    three = ml.random_search(folds, FIELDS, F.col("y"), space, 3, 5, "tree", store).collect()
    assert three[:2] == two and len(three) == 3 and store.table().count() == 3


def test_sequential_test_stops(spark):
    rng = random.Random(3)
    make = lambda shift: spark.createDataFrame([(rng.gauss(shift, 1), rng.gauss(0, 1)) for _ in range(30)], "a double, b double")
    k, p = stats.sequential_wilcoxon([make(3), make(3)], "a", "b")
    assert k == 1 and p < 0.05
    same = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert stats.sequential_wilcoxon([same, same], "a", "b") == (2, 1.0)
    z = stats.with_normal_p(spark.createDataFrame([(0.0,), (1.959964,), (-3.0,), (40.0,)], "z double")).collect()
    assert [r["p"] for r in z] == pytest.approx([1.0, 0.05, stats.normal_p(3), 0.0], abs=1e-7)
