"""Typical members of a cluster: the middle of its densest cell, not its smallest numbers."""

from cohortex.llm.clusters import describe_clusters, similar_groups


def test_typical_members_are_central(spark):
    low, high = 1_000.0, 1_200.0  # one cell: log10 from 3.0 to 3.1
    rows = [(i, low + (high - low) * i / 100, 3) for i in range(101)]
    members = similar_groups(spark.createDataFrame(rows, "c long, x double, b int"), "c", "x", "b")
    assert len({r["typicality"] for r in members.collect()}) == 1
    d = describe_clusters(members, "c").collect()
    assert len(d) == 1 and d[0]["size"] == 101
    assert all(45 <= d[0][f"typical_{k}"] <= 55 for k in (1, 2, 3))
