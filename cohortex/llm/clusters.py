"""Clusters of similar records by Markov clustering on a sparse similarity graph."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohortex.staging import release, stage


def cells(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One row per occupied cell of the integer coordinates ``dims``: the coordinates, ``n`` and ``cell`` (a 64-bit id)."""
    at = df.select(*[c.cast("int").alias(d) for d, c in dims.items()]).dropna()
    return at.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell_id(list(dims)))


def cell_id(dims: list[str]) -> Column:
    return F.xxhash64(*dims)


def neighbour_graph(nodes: DataFrame, reach: dict[str, int], fixed: list[str]) -> DataFrame:
    """Links between occupied cells at most ``reach`` steps apart and equal in ``fixed``: ``src, dst, w``.

    w falls with the distance from 1 to exp(-2) at the reach.  Each cell looks
    up its (bounded number of) neighbouring coordinates by an equi-join; no
    pair of cells that are further apart is ever formed.
    """
    axes = list(reach)
    steps = [(s, sum((x / (reach[a] + 1e-9)) ** 2 if reach[a] else 0.0 for a, x in zip(axes, s)) / max(1, len(axes))) for s in product(*[range(-reach[a], reach[a] + 1) for a in axes])]
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"o_{a}") for a, x in zip(axes, s)], F.lit(float(2.718281828459045 ** (-2 * d))).alias("w")) for s, d in steps])
    wide = nodes.select(F.col("cell").alias("src"), *fixed, *axes, F.explode(offsets).alias("o")).select(
        "src", *[F.col(c).alias(f"k_{c}") for c in fixed], *[(F.col(a) + F.col(f"o.o_{a}")).cast("int").alias(f"k_{a}") for a in axes], F.col("o.w").alias("w")
    )
    to = nodes.select(F.col("cell").alias("dst"), *[F.col(c).alias(f"k_{c}") for c in (*fixed, *axes)])
    return wide.join(to, [f"k_{c}" for c in (*fixed, *axes)]).select("src", "dst", "w")


def markov_clusters(nodes: DataFrame, links: DataFrame, inflation: float = 2.0, prune: float = 1e-3, max_rounds: int = 100, tolerance: float | None = None) -> DataFrame:
    """Markov clustering: ``node, cluster, flow`` with the attractor each node's strongest flow ends in.

    nodes: ``node`` and ``n``, how many identical records the node stands for.
    links: ``src, dst, w`` with w > 0, both directions; self links are added.

    The matrix holds, per column j, the flow from one record of node j to all
    records of node i.  A round squares it by one equi-join and a map-side
    combined sum, raises the flow per record to ``inflation`` (i gets
    n_i * (m_ij / n_i) ** inflation, the exact result for n_i separate rows),
    drops what is below ``prune`` of a column's sum and renormalises.  That is
    the same as clustering the graph of all records with copies expanded, at
    the cost of one node per distinct record.  Columns keep all entries above
    ``prune``, hence at most 1 / prune of them.

    A round is one job: columns are cut and divided by their sums in windows,
    which see at most (1 / prune) ** 2 entries of a squared column, whatever the
    number of records.  On the way it finds the largest chaos of a column: its
    largest flow to one record less the sum of squares, 0 where the flow is
    spread evenly over the attractors.  The rounds end when no column's chaos
    exceeds ``tolerance`` (by default ``prune``); that more than ``max_rounds`` are needed is an error.
    A node's cluster is named by the smallest attractor its strongest attractor
    flows to.  Nodes without links are clusters of their own.
    """
    tolerance = prune if tolerance is None else tolerance
    if tolerance > prune:
        raise ValueError("tolerance must not exceed prune, else columns may keep entries that are no attractors")
    size = stage(nodes.groupBy("node").agg(F.sum("n").alias("n")), "nodes")
    both = links.where("w > 0 and src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))
    loops = size.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    flow = both.unionByName(loops).join(size.select(F.col("node").alias("dst"), "n"), "dst").select(F.col("src").alias("j"), F.col("dst").alias("i"), (F.col("w") * F.col("n")).alias("m"), "n")
    sums = flow.groupBy("j").agg(F.sum("m").alias("all"), F.max("m").alias("top"))  # a hub's links are summed map-side, not gathered
    flow = flow.join(sums, "j").where((F.col("m") >= prune * F.col("all")) | (F.col("m") == F.col("top"))).select("j", "i", "m", "n")
    m, chaos = _columns(flow, prune)
    for _ in range(max_rounds):
        left = m.select(F.col("j").alias("k"), "i", F.col("m").alias("a"), "n")
        right = m.select("j", F.col("i").alias("k"), F.col("m").alias("b"))
        square = left.join(right, "k").groupBy("j", "i").agg(F.sum(F.col("a") * F.col("b")).alias("m"), F.max("n").alias("n"))
        new, chaos = _columns(square.select("j", "i", (F.col("n") * F.pow(F.col("m") / F.col("n"), F.lit(inflation))).alias("m"), "n"), prune)
        release(m)
        m = new
        if chaos < tolerance:
            break
    else:
        raise RuntimeError(f"the flow did not settle in {max_rounds} rounds (chaos {chaos})")
    best = F.min_by(F.struct("i", "m"), F.struct(-F.col("m"), F.col("i")))
    top = m.groupBy("j").agg(best.alias("best"), F.min("i").alias("first"))
    names = top.select(F.col("j").alias("attractor"), F.col("first").alias("cluster"))
    found = stage(top.select(F.col("j").alias("node"), F.col("best.i").alias("attractor"), F.col("best.m").alias("flow")).join(names, "attractor").select("node", "cluster", "flow"), "clusters")
    release(m, size)
    return found


def _columns(flow: DataFrame, prune: float) -> tuple[DataFrame, float]:
    """Columns without entries below ``prune`` of their sum (never without their largest), scaled to sum 1 and staged, and the largest chaos among them."""
    column = Window.partitionBy("j")
    cut = flow.select("*", F.sum("m").over(column).alias("all"), F.max("m").over(column).alias("top")).where((F.col("m") >= prune * F.col("all")) | (F.col("m") == F.col("top")))
    kept = cut.select("j", "i", "n", (F.col("m") / F.sum("m").over(column)).alias("m"))
    seen = Observation()
    chaos = F.max(F.col("m") / F.col("n")).over(column) - F.sum(F.col("m") * F.col("m") / F.col("n")).over(column)
    out = stage(kept.withColumn("chaos", chaos).observe(seen, F.max("chaos").alias("chaos")).drop("chaos"), "flow")
    return out, seen.get["chaos"] or 0.0


def usual_levels(df: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """``entity`` and the (lower) median of each field over its rows; null where an entity has no finite value of a field.

    ``percentile_approx`` merges bounded summaries map-side, so an entity with
    a third of all rows costs one task nothing; its rank error is 1 / 5000 of
    the entity's rows, none below about 5000 rows.
    """
    x = df.where(F.col(entity).isNotNull()).select(entity, *[F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < F.lit(float("inf"))), F.col(f)).alias(f) for f in fields])
    return x.groupBy(entity).agg(*[F.percentile_approx(f, 0.5, 5000).alias(f) for f in fields])


def similar_groups(levels: DataFrame, entity: str, amount: str, count: str, step: float = 0.1, reach: int = 3, count_reach: int = 1) -> DataFrame:
    """``entity, cluster, typicality, distance``: entities alike in the sign and ratio of ``amount`` and in ``count``.

    levels: one row per entity (staged).  Amounts are alike by sign and ratio:
    the coordinate is log10(1 + |amount|) in steps of ``step`` (a factor of
    1.26), and records within ``reach`` steps (a factor of 2) and
    ``count_reach`` of the count are linked.  Entities of one cell are copies
    in the similarity graph.  typicality: the share of the cell's flow that
    ends in its attractor, times the cell's share of its cluster, so the most
    typical members sit where the cluster is densest.  distance: how far the
    entity itself, not its cell, is from the mean of its cluster's members, in
    reaches; it tells the members of a cell apart.  Entities without an amount
    or a count are alike in nothing that can be compared: those that lack the
    same are one cluster, of typicality 0 and no distance.
    """
    dims = {
        "__s": F.when(F.col(amount) < 0, -1).otherwise(1),
        "__b": F.floor(F.log10(F.abs(F.col(amount).cast("double")) + 1) / step),
        "__c": F.round(F.col(count).cast("double")),
    }
    nodes = stage(cells(levels, dims), "cells")
    graph = neighbour_graph(nodes, {"__b": reach, "__c": count_reach}, ["__s"])
    found = stage(markov_clusters(nodes.select(F.col("cell").alias("node"), "n"), graph), "clusters")
    total = Window.partitionBy("cluster")
    scored = found.join(nodes.select(F.col("cell").alias("node"), "n"), "node").select("node", "cluster", (F.col("flow") * F.col("n") / F.sum("n").over(total)).alias("typicality"))
    own = {"__x": F.log10(F.abs(F.col(amount).cast("double")) + 1) / (step * max(1, reach)), "__y": F.col(count).cast("double") / max(1, count_reach)}
    tagged = levels.select(entity, *[c.cast("int").alias(d) for d, c in dims.items()], *[c.alias(d) for d, c in own.items()]).dropna().select(entity, *own, cell_id(list(dims)).alias("node"))
    members = stage(tagged.join(scored, "node").select(entity, "cluster", "typicality", *own), "placed")
    centres = members.groupBy("cluster").agg(F.avg("__x").alias("__cx"), F.avg("__y").alias("__cy"))
    distance = F.round(F.sqrt(F.pow(F.col("__x") - F.col("__cx"), 2.0) + F.pow(F.col("__y") - F.col("__cy"), 2.0)), 9)  # rounded: sums of doubles depend on their order
    placed = members.join(centres, "cluster").select(entity, "cluster", "typicality", distance.alias("distance"))
    lacking = levels.where(F.col(amount).isNull() | F.col(count).isNull())
    return placed.unionByName(lacking.select(entity, F.xxhash64(F.col(amount).isNull(), F.col(count).isNull()).alias("cluster"), F.lit(0.0).alias("typicality"), F.lit(None).cast("double").alias("distance")))


def describe_clusters(members: DataFrame, entity: str, typical: int = 3) -> DataFrame:
    """``cluster, size, typical_1..n``: every cluster's size and its members of strongest flow (ties: nearest to the cluster's mean, then smallest entity)."""
    best = Window.partitionBy("cluster").orderBy(F.col("typicality").desc(), F.col("distance").asc_nulls_last(), entity)
    top = members.withColumn("r", F.row_number().over(best)).where(F.col("r") <= typical)
    wide = top.groupBy("cluster").agg(*[F.max(F.when(F.col("r") == i, F.col(entity))).alias(f"typical_{i}") for i in range(1, typical + 1)])
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(wide, "cluster")
