import pytest
from pyspark.sql import functions as F

from cohortex.functions.periods import derive_folds, month_range, offset
from cohortex.operators.features import FeaturePlan, RowSpec, build_features, resolve_fields, select_blocks
from cohortex.operators.panel import churn_target, churn_target_by_gaps, dense_panel, gaps
from cohortex.operators.ranks import deflated, ntiles, percent_ranks, signed_ranks
from cohortex.operators.series import Catalog, SeriesSpec, add_series, check_no_future

MONTHS = [202103, 202104, 202105, 202106, 202107]


def mini(spark):
    rows = [(48000000, m, 1.0) for m in MONTHS] + [(2, 202103, 1.0), (3, 202103, 1.0), (3, 202104, 1.0), (4, 202103, 10.0), (4, 202105, 30.0)]
    return spark.createDataFrame(rows, "c long, t int, x double")


def test_target_classes(spark):
    y = {(r["c"], r["t"]): r["target"] for r in churn_target(mini(spark), "c", "t").collect()}
    assert y[2, 202103] == "BAJA+1" and y[3, 202103] == "BAJA+2" and y[3, 202104] == "BAJA+1"
    assert y[48000000, 202105] == "CONTINUA" and y[48000000, 202106] is None and y[48000000, 202107] is None
    assert y[4, 202103] == "CONTINUA"  # absent next, back after: stays
    assert {(r["c"], r["t"]): r["target"] for r in churn_target_by_gaps(mini(spark), "c", "t").collect()}[4, 202103] == "BAJA+1"
    assert churn_target(mini(spark).limit(0), "c", "t").count() == 0


def test_gap_semantics(spark):
    s = add_series(dense_panel(mini(spark), "c", "t"), "c", "t", ["x"], SeriesSpec(delta_pcts=()))
    r = s.where("c = 4 and t = 202105").first()
    assert r["lag_1_x"] is None and r["lag_2_x"] == 10.0 and r["delta_1_x"] is None and r["delta_2_x"] == 20.0 and r["avg_3_x"] == 20.0
    assert {r["c"] for r in gaps(mini(spark), "c", "t").collect()} == {4}
    full = dense_panel(mini(spark).where("t <> 202104"), "c", "t", "full")
    assert full.select("t").distinct().count() == 5


def test_future_is_refused(spark):
    from pyspark.sql import Window

    p = dense_panel(mini(spark), "c", "t")
    check_no_future(add_series(p, "c", "t", ["x"]))
    w = Window.partitionBy("c").orderBy("t")
    for bad in (F.lead("x", 1).over(w), F.avg("x").over(w.rowsBetween(-1, 1)), F.sum("x").over(w.rowsBetween(0, Window.unboundedFollowing))):
        with pytest.raises(ValueError):
            check_no_future(p.withColumn("z", bad))


def test_ranks(spark):
    rows = [(i, 1, x) for i, x in enumerate([5.0, 5.0, None, -2.0, 0.0, 7.0, -9.0])] + [(99, 2, 3.0)]
    d = spark.createDataFrame(rows, "c long, t int, x double")
    p = {r["c"]: (r["pr_x"], r["dec_x"]) for r in percent_ranks(d, "t", ["x"], ["c"]).collect()}
    assert p[2] == (None, None) and p[6] == (0.0, 1) and p[0] == p[1] == (0.6, 7) and p[5] == (1.0, 10) and p[99] == (0.0, 1)
    s = {r["c"]: r["sr_x"] for r in signed_ranks(d, "t", ["x"], ["c"]).collect()}
    assert s[4] == 0.0 and s[2] is None and s[5] == 1.0 and s[0] == s[1] == pytest.approx(2 / 3) and s[6] == -1.0 and s[3] == -0.5
    m = deflated(d, "t", ["x"]).where("t = 1 and x > 0").agg(F.median("df_x")).first()[0]
    assert m == pytest.approx(1.0)
    n = {r["c"]: (r["place"], r["ntile_3"]) for r in ntiles(d.where("t = 1"), "t", "x", "c", [3]).collect()}
    assert n[6] == (1, 1) and n[4] == (3, 1) and n[0] == (4, 2) and n[2] == (7, 3)


def test_feature_plan_and_catalog(spark):
    d = mini(spark).withColumn("y", F.col("x") * 2)
    plan = FeaturePlan(rows=RowSpec(sums={"s": ("x", "y"), "gone": ("x", "nope")}, ratios={"r": ("s", "y")}, flags={"big": "x > 5"}), series_fields=("x", "s"), rank_fields=("x",))
    df, cat = build_features(d, "c", "t", plan)
    names = [r[1] for r in cat.rows]
    assert df.count() == d.count() and "gone" not in df.columns and len(names) == len(set(names)) and set(names) <= set(df.columns)
    c = Catalog()
    c.add("b", "f", "e", "o")
    with pytest.raises(ValueError):
        c.add("b", "f", "e", "o")
    assert resolve_fields(d, "curado", ["x", "nope"]) == ["x"] and resolve_fields(d, "todos", [], frozenset({"c"})) == ["t", "x", "y"]
    with pytest.raises(ValueError):
        resolve_fields(d, ["nope"], [])
    blocks = [("lags", "lag_1_x"), ("rankings", "pr_x")]
    assert select_blocks(["x", "lag_1_x", "pr_x"], blocks, only=["derivadas"], without=["lags"]) == ["pr_x"]
    with pytest.raises(ValueError):
        select_blocks(["x"], blocks, only=["typo"])


def test_periods():
    assert offset(202101, -1) == 202012 and month_range(202011, 202102) == [202011, 202012, 202101, 202102] and month_range(202102, 202101) == []
    f = derive_folds(202108, 2, 3, 2)
    assert f[0] == {"valid": 202106, "train": [202102, 202103, 202104]} and f[1]["valid"] == 202105
    with pytest.raises(ValueError):
        derive_folds(202108, 0, 3, 1)
