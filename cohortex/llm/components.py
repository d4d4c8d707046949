"""Connected components by hooking and shortcutting over a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.staging import release, stage


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Rows with a null end, self loops, repeated and reversed rows add nothing
    (a node seen only in a self loop still comes out, on its own).

    ``parent`` holds one row a node.  A round hooks: every link between two
    roots hangs the larger root under the smallest one it meets; then it
    shortcuts: parents are replaced by their parents until every node points to
    a root.  Links are rewritten to their roots and made distinct before the
    next round, so links inside a component vanish and a hub shrinks with every
    round.  The minimum per root is taken map-side first; no list of
    neighbours is ever built.  Each round is staged on shared storage.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    parent = stage(nodes.select("node", F.col("node").alias("root")), "parent")
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        hooks = stage(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "hooks")
        while True:  # hooks only point to smaller roots, so chains end; halve them until none is left
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stage(hooks.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            release(hooks)
            hooks = jumped.drop("moved")
            hooks._staged_path = jumped._staged_path
            if not moved:
                break
        h = hooks.select(F.col("node").alias("root"), "up")
        new_parent = stage(parent.join(h, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "parent")
        moved_hi = links.join(hooks.select(F.col("node").alias("hi"), F.col("up").alias("hi_up")), "hi", "left")
        moved = moved_hi.join(hooks.select(F.col("node").alias("lo"), F.col("up").alias("lo_up")), "lo", "left").select(F.coalesce("hi_up", "hi").alias("x"), F.coalesce("lo_up", "lo").alias("y"))
        new_links = stage(moved.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "links")
        release(parent, links, hooks)
        parent, links = new_parent, new_links
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(links)
    return parent.select("node", F.col("root").alias("component"))
