import random

import pytest
from pyspark.sql import functions as F

from cohortex.functions.exprs import normal, splitmix64_uniform
from cohortex.operators import compare, ensemble, metrics, sampling
from cohortex.operators.quality import gates, require_columns, require_periods, same_summary
from cohortex.operators.ranking import running_by_order, running_in_groups, uniform
from cohortex.sources import io


def pairs(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, round(rng.random(), 2), rng.random() < 0.3) for i in range(n)]


def test_auc_by_pairs(spark):
    rows = pairs(150)
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    d = spark.createDataFrame(rows, "id long, s double, y boolean")
    assert metrics.auc(d, [], "s", "y").first()["auc"] == pytest.approx(want)
    assert metrics.auc(d.where("y"), [], "s", "y").first()["auc"] is None


def test_curve_and_plateau(spark):
    rows = pairs()
    d = spark.createDataFrame(rows, "id long, s double, y boolean")
    best = sorted(rows, key=lambda r: (-r[1], r[0]))
    total, want = 0, []
    for _, _, y in best:
        total += 39 if y else -1
        want.append(total)
    got = [r["gain"] for r in metrics.gain_curve(d, [], "s", "y", "id", 39, 1).orderBy("k").collect()]
    assert got == want
    sm = {r["k"]: r["smoothed"] for r in metrics.plateau(metrics.gain_curve(d, [], "s", "y", "id", 39, 1), [], 10).collect()}
    assert set(sm) == set(range(5, 397)) and sm[5] == pytest.approx(sum(want[:9]) / 9) and sm[396] == pytest.approx(sum(want[-9:]) / 9)  # an even window is one less
    short = spark.createDataFrame([("a", k, want[k - 1]) for k in range(1, 46)] + [("b", k, want[k - 1]) for k in range(1, 3)] + [(None, 1, 7)], "g string, k long, gain long")
    got = {(r["g"], r["k"]): r["smoothed"] for r in metrics.plateau(short, ["g"], 401).collect()}
    assert got == {("a", 23): pytest.approx(sum(want[:45]) / 45), ("b", 1): want[0], ("b", 2): want[1], (None, 1): 7.0}
    with pytest.raises(Exception, match="null or NaN"):
        metrics.gain_curve(spark.createDataFrame([(1, float("nan"), True)], "id long, s double, y boolean"), [], "s", "y", "id", 39, 1).collect()
    cut = metrics.best_cut(spark.createDataFrame(list(sm.items()), "k long, smoothed double"), []).first()
    assert cut["k"] == min(k for k, v in sm.items() if v == max(sm.values()))


def test_running_sums_split_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else None, rng.randrange(50), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, x long, i long")
    got = {r["i"]: (r["pos"], r["cum_x"]) for r in running_by_order(d, ["g"], [F.col("x").desc(), F.col("i").asc()], ["x"], parts=7).collect()}
    for g in ("hot", None):
        at = 0
        for k, (_, x, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            at += x
            assert got[i] == (k + 1, at)
    h = running_in_groups(d.withColumn("u", uniform("i", seed=1)), ["g"], "u", ["i"], "x", slice_rows=100)
    rows2 = h.select("g", "u", "x", "pos", "n", "cum", "total").collect()
    for g in ("hot", None):
        at = 0
        mine = sorted((r for r in rows2 if r["g"] == g), key=lambda r: r["u"])
        for k, r in enumerate(mine):
            at += r["x"]
            assert (r["pos"], r["cum"], r["n"]) == (k + 1, at, len(mine)) and r["total"] == sum(q["x"] for q in mine)


def test_top_cut_and_contract(spark):
    d = spark.createDataFrame([(999_999_999_999, 0.5), (7, 0.5), (8, 0.1)], "id long, s double")
    assert [r["id"] for r in metrics.top_n(d, "id", "s", 2).collect()] == [7, 999_999_999_999]
    for bad in (0, 4):
        with pytest.raises(ValueError):
            metrics.top_n(d, "id", "s", bad)
    assert metrics.auto_cut([10_000, 12_000], 200, 100) == 22_000 and metrics.auto_cut([1], 1, 1) == 500 and metrics.resolve_cuts([3, 1, 3]) == [1, 3] and metrics.auto_cut([750], 1, 1) == 1000
    v = metrics.contract_violations(spark.createDataFrame([("a", None, 0.1), ("a", 1, float("nan")), ("a", 1, 2.0), ("a", 2, None)], "m string, id long, s double"), ["m"], "id", "s").first()
    assert (v["null_ids"], v["repeated_ids"], v["missing_scores"], v["outside_scores"]) == (1, 1, 2, 1)


def test_ensemble(spark):
    rows = [("a", 1, 0.1), ("a", 2, 0.2), ("a", 3, 0.2), ("b", 1, 10.0), ("b", 2, 20.0), ("b", 3, 30.0)]
    d = spark.createDataFrame(rows, "m string, id long, s double")
    got = {r["id"]: r["prob"] for r in ensemble.combine(d, "m", "id", "s").collect()}
    assert got[1] == pytest.approx(1 / 3) and got[2] == pytest.approx((2.5 / 3 + 2 / 3) / 2) and got[3] == pytest.approx((2.5 / 3 + 1) / 2)
    for bad, how in ((d.where("not (m = 'b' and id = 3)"), {}), (d.where("m = 'a'"), {}), (d, {"weights": {"a": 1.0}}), (d, {"weights": {"a": 1.0, "b": 0.0}}), (d, {"method": "max"})):
        with pytest.raises(ValueError):
            ensemble.combine(bad, "m", "id", "s", **how)
    three = {r["id"]: r["prob"] for r in ensemble.combine(d, "m", "id", "s", weights={"a": 3.0, "b": 1.0}).collect()}
    assert three[1] == pytest.approx(1 / 3) and three[3] == pytest.approx((3 * 2.5 / 3 + 1) / 4)
    apart = d.unionByName(d.where("id < 3").withColumn("id", F.col("id") + 10)).withColumn("g", (F.col("id") > 5).cast("int"))
    assert ensemble.combine(apart, "m", "id", "s", groups=("g",)).count() == 5 and ensemble.common_entities(d.where("not (m = 'b' and id = 3)"), "m", "id").count() == 4
    j = ensemble.jaccard(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "m string, id long"), "m", "id").first()
    assert (j["both"], j["jaccard"]) == (1, pytest.approx(1 / 3))


def test_samples(spark):
    d = spark.range(20_000).select(F.col("id").alias("c"), F.lit(202106).alias("t"), F.when(F.col("id") % 50 == 0, "BAJA+2").otherwise("CONTINUA").alias("k"))
    u = d.select(splitmix64_uniform("c", "t", 7).alias("u"))
    a = u.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] and a[2] < 1
    s = sampling.undersample(d, "c", "t", F.col("k") == "BAJA+2", 0.1, 7)
    assert s.where("k = 'BAJA+2'").count() == 400 and abs(s.count() - 400 - 1960) < 150
    assert sorted(r["c"] for r in s.collect()) == sorted(r["c"] for r in sampling.undersample(d.repartition(7), "c", "t", F.col("k") == "BAJA+2", 0.1, 7).collect())
    b = {(r["k"], r["block"]): r["count"] for r in sampling.stratified_blocks(d, ["k"], ["c"], [7, 3], 1).groupBy("k", "block").count().collect()}
    assert b == {("BAJA+2", 1): 280, ("BAJA+2", 2): 120, ("CONTINUA", 1): 13720, ("CONTINUA", 2): 5880}


def plain_splitmix(entity, period, seed):
    """The number by Python's whole integers."""
    full = (1 << 64) - 1
    z = (((entity * 1_000_003 + period) & full) ^ seed) + 0x9E3779B97F4A7C15 & full
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & full
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & full
    return ((z ^ z >> 31) >> 11) / (1 << 53)


def test_named_numbers(spark):
    rows = [(1, 202106), (48_000_123, 202101), (999_999_999_999, 202112), (None, 202101), (5, None)]
    got = [r["u"] for r in spark.createDataFrame(rows, "c long, t int").select(splitmix64_uniform("c", "t", 104729).alias("u")).collect()]
    assert got[:3] == [plain_splitmix(c, t, 104729) for c, t in rows[:3]] and got[3:] == [None, None]
    n = spark.range(20_000).select(normal("id", seed=3).alias("x")).agg(F.avg("x"), F.stddev("x"), F.max("x")).first()
    assert abs(n[0]) < 0.03 and abs(n[1] - 1) < 0.02 and 3 < n[2] < 7


def test_public_parts_are_exact(spark):
    people = spark.range(103).select(F.col("id"), (F.col("id") < 13).alias("y"))
    p = compare.public_parts(people, "id", "y", 4, 0.3, 7)
    assert {(r["sim"], r["y"]): r["public"] for r in p.groupBy("sim", "y").agg(F.sum(F.col("public").cast("int")).alias("public")).collect()} == {(k, y): n for k in range(4) for y, n in ((True, 4), (False, 27))}
    sent = spark.createDataFrame([(m, i) for m, ids in (("a", range(0, 20)), ("b", range(90, 103))) for i in ids], "m string, id long")
    r = {x["m"]: x for x in compare.simulate_public_private(people, sent, "m", "id", "y", 39, 1, 4, 0.3, 7).collect()}
    assert (r["a"]["wins"], r["a"]["wins_private"], r["a"]["regret"], r["b"]["wins"]) == (4, 4, 0.0, 0) and r["a"]["private_mean"] > 300
    assert compare.winner_risk(spark.createDataFrame([(2, 1, 5.0), (2, 2, 0.0), (0, 0, None)], "wins long, wins_private long, regret double")).first().asDict() == {"sims": 4, "loses": 0.25, "regret": 2.5}


def test_comparisons(spark):
    rows = [(v, s, f, base + 0.01 * s) for v, base in (("ref", 1.0), ("better", 2.0), ("same", 1.0)) for s in range(5) for f in (0, 1)]
    got = {r["v"]: r["verdict"] for r in compare.paired_comparison(spark.createDataFrame(rows, "v string, s long, f long, x double"), "v", "ref", "s", "f", "x").collect()}
    assert got == {"ref": "referencia", "better": "mejor", "same": "indistinguible"}
    t = compare.trial_stability(spark.createDataFrame([(3, 1.0), (3, 1.0), (1, 1.0), (1, 1.0), (2, 0.5)], "t long, x double"), "t", "x")
    assert [r["t"] for r in t.where("chosen").collect()] == [1]
    with pytest.raises(ValueError):
        compare.canary_test(spark.createDataFrame([("canarito_1", "b", 1.0)], "f string, b string, g double"), "f", "b", "g")


def test_gates(spark):
    d = spark.createDataFrame([(1, 2, "A", 1.0), (1, 2, "Z", float("inf")), (None, 2, None, 1.0)], "c long, t int, k string, x double")
    assert {r["gate"]: r["violations"] for r in gates(d, ["c", "t"], "k", ["A"], ["x"]).collect()} == {"null_keys": 1, "repeated_keys": 1, "outside_domain": 1, "infinite_amounts": 1}
    with pytest.raises(ValueError):
        require_columns(d, {"c": "int"})
    with pytest.raises(ValueError):
        require_periods(d, "t", [2, 3])
    assert same_summary(d, d) and not same_summary(d, d.limit(1))


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([(5,), (48000000,), (7,)], "id long")
    p = f"file://{tmp_path}/ids"
    io.write_id_list(ids, "id", p, 3, ids)
    assert sorted(r[0] for r in spark.read.text(p).collect()) == ["48000000", "5", "7"]
    for bad, n, valid in ((ids.unionByName(ids.limit(1)), 4, None), (ids, 2, None), (ids, 3, ids.where("id <> 7"))):
        with pytest.raises(ValueError):
            io.write_id_list(bad, "id", f"file://{tmp_path}/bad", n, valid)
        assert not (tmp_path / "bad").exists()
    io.write_parquet(ids, f"file://{tmp_path}/t")
    io.write_parquet(ids.limit(1), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1 and len(list(tmp_path.glob("t.tmp*"))) == 0
    plan = io.read_parquet(spark, f"file://{tmp_path}/t", ["id"], id=[5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [IsNotNull(id), EqualTo(id,5)" in plan or "EqualTo(id,5)" in plan
