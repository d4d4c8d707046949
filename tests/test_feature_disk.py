"""Wide rows of the feature table are neither staged nor shuffled."""

import pytest

from cohortex import staging
from cohortex.operators import features, ranks
from cohortex.operators.features import Behaviour, FeaturePlan, RowSpec, build_features
from cohortex.operators.ranks import percent_ranks


def shuffled_widths(df):
    """Columns of every exchange in the plan of ``df``."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.initialPlan())
        if p.nodeName() == "Exchange":
            out.append(p.output().size())
        c = p.children()
        todo += [c.apply(i) for i in range(c.size())]
    return out


def table(spark, rows=60):
    return spark.createDataFrame([(i % 9, 202101 + i // 9, float(i * 7 % 11) if i % 5 else None, float(i % 4)) for i in range(rows)], "c long, t int, x double, y double")


def test_only_narrow_rows_reach_the_disk(spark, monkeypatch):
    plan = FeaturePlan(rows=RowSpec(sums={"s": ("x", "y")}), series_fields=("x", "y", "s"), rank_fields=("x", "s"), behaviour=Behaviour(recency={"since": ("x > 5", ("x",))}), rfm=("since", "y", "x"))
    widths = []

    def noted(df, label):
        widths.append(len(df.columns))
        return staging.stage(df, label)

    monkeypatch.setattr(features, "stage", noted)
    monkeypatch.setattr(ranks, "stage", noted)
    df, _ = build_features(table(spark), "c", "t", plan)
    narrow = 4 + 1 + 2 + 3  # the fact, presence, two counts; entity and period beside the counts, and the score
    assert len(df.columns) > 40 and max(widths) <= narrow and max(shuffled_widths(df)) <= narrow
    assert df.count() == 60


def test_fields_ranked_in_turns_are_ranked_alike(spark, monkeypatch):
    d = table(spark).withColumn("z", -features.F.col("x") * features.F.col("y"))
    whole = {tuple(r) for r in percent_ranks(d, "t", ["x", "y", "z"], ["c"]).collect()}
    monkeypatch.setattr(ranks, "TURN_VALUES", 1)
    monkeypatch.setattr(ranks, "TURN_FIELDS", 1)
    before = set(staging._made)
    assert {tuple(r) for r in percent_ranks(d, "t", ["x", "y", "z"], ["c"]).collect()} == whole and len(whole) == 60
    assert len(set(staging._made) - before) == 2  # the counts and the groups' sizes; all else is deleted


def test_shuffles_of_a_staged_copy_are_deleted(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, known = spark.conf.get(key), tracker.shuffleStatuses().size()
    staging.stage(table(spark).groupBy("t").count().repartition(3), "x")
    assert tracker.shuffleStatuses().size() <= known and spark.conf.get(key) == was


@pytest.mark.parametrize("calendar", ["observed", "full"])
def test_ghosts_are_seen_by_series(spark, calendar):
    d = table(spark).where("not (c = 4 and t = 202103)")
    plan = FeaturePlan(rows=RowSpec(sums={"s": ("x", "y")}), series_fields=("y", "s"), rank_fields=("y",), calendar=calendar)
    r = build_features(d, "c", "t", plan)[0].where("c = 4 and t = 202104").first()
    assert r["lag_1_y"] is None and r["lag_1_s"] == 0.0 and r["lag_2_y"] is not None and r["pr_y"] is not None and r["place"] == 4
