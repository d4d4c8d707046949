"""Mixes of sources by weight: hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.llm.tokens import VOCABULARY, token_sizes
from cohortex.operators.ranking import running_in_groups, uniform
from cohortex.staging import stage


@dataclass
class Node:
    """A domain, a language of a domain, or (a leaf) a source.

    weight, capacity: sums over the leaves below.  claim: the part of the total
    that the weights ask for; budget: what the node gets.
    """

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    claim: float = 0.0
    budget: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)

    def add(self, path: tuple[str, ...], weight: float, capacity: float) -> None:
        """A leaf below this node.  One of no weight may receive nothing, so it adds no capacity either."""
        self.weight += weight
        self.capacity += capacity if weight > 0 else 0.0
        if path:
            self.children.setdefault(path[0], Node(path[0])).add(path[1:], weight, capacity)

    def leaves(self, path: tuple[str, ...] = ()):
        if not self.children:
            yield path, self
        for c in self.children.values():
            yield from c.leaves((*path, c.name))

    @property
    def short(self) -> bool:
        """The node gets less than its weight asks for."""
        return self.budget < self.claim * (1 - 1e-12) - 1e-9


def source_path(source: str, language: str | None) -> tuple[str, str, str]:
    """Domain (the name up to the first underscore), language (``und`` where unknown) and source."""
    return source.split("_")[0], language or "und", source


def allot(node: Node, total: float, claim: float | None = None) -> None:
    """Give ``total`` to a node and share it among its children by weight; claims go down by weight alone.

    A child whose capacity is below its part gets its capacity; what is missing
    goes to its siblings with room, by weight, until none is left or none has
    room.  What siblings cannot take stays with the parent's parent, which has
    then already offered it to the parent's siblings: a node never gets more
    than the capacity below it.
    """
    node.claim = total if claim is None else claim
    node.budget = min(total, node.capacity)
    given = {k: 0.0 for k in node.children}
    rest = node.budget
    open_ = {k: c for k, c in node.children.items() if c.weight > 0 and c.capacity > 0}
    while open_:
        each = rest / sum(c.weight for c in open_.values())
        full = [k for k, c in open_.items() if each * c.weight >= c.capacity]
        for k in full or list(open_):
            c = open_.pop(k)
            given[k] = c.capacity if full else each * c.weight
            rest -= given[k]
    for k, c in node.children.items():
        allot(c, given[k], node.claim * c.weight / node.weight if node.weight > 0 else 0.0)


@dataclass
class Mix:
    """``rows``: one row per use of a document; ``report``: one row per wanted source."""

    rows: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame, doc: str, text: str, source: str, wanted: DataFrame, weight: str, most: str, total_tokens: int | None = None,
    language: str | None = None, path: Callable[[str, str | None], tuple[str, ...]] = source_path, vocabulary: str = VOCABULARY, seed: int = 5,
) -> Mix:
    """A mix in which every source of ``wanted`` has its ``weight`` of ``total_tokens`` and is used at most ``most`` times.

    wanted: the caller's small table, one row per source; it and one size per
    wanted source reach the driver.  Sources are compared trimmed and in lower
    case.  total_tokens: by default the size of all documents with text, of any
    source.  Documents without text, or of no tokens, are in no mix.

    language: a column of ``docs``; a source's language is the one of most of
    its documents with text (first two letters, ties to the first in order).
    Sources are the leaves of a domain-language-source tree (``path``), through
    which weights go down and shortages are shared out.

    ``report``: ``source, weight, max_uses, size, target, capacity, short,
    budget, tokens, share``: target is the leaf's claim in the tree, capacity =
    max_uses * size, budget what the tree gives the leaf after what short
    sources lack went to their siblings, then to the siblings of their
    ancestors; short: the budget is below the claim; tokens and share are what
    the mix really holds.  A source of weight 0 gets nothing.

    ``rows``: ``doc_id, source, epoch, tokens``.  A source is read in epochs,
    each in its own seeded order; whole epochs come first, then the prefix of
    the next whose tokens still fit the budget.  Running sums are made in slices
    of the order, so a source with a third of all documents is no single task.
    """
    name = F.lower(F.trim(F.col(source)))
    lang = F.substring(F.lower(F.trim(F.col(language))), 1, 2) if language else F.lit(None).cast("string")
    sizes = stage(token_sizes(docs, doc, text, {"source": name, "lang": lang}, vocabulary), "tokens")
    goals = {}
    for r in wanted.select(F.lower(F.trim(F.col(source))).alias("s"), F.col(weight).cast("double").alias("w"), F.col(most).cast("long").alias("m")).where("s is not null").collect():
        goals[r["s"]] = (max(0.0, r["w"] or 0.0), max(0, r["m"] or 0))
    by_lang = sizes.where(F.col("source").isin(list(goals)) & F.col("tokens").isNotNull()).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("n"))
    main = F.min_by("lang", F.struct(-F.col("docs"), F.col("lang"))).alias("lang")
    known = by_lang.groupBy("source").agg(F.sum("n").alias("n"), main).collect()  # one row per wanted source
    per, tongue = {r["source"]: r["n"] for r in known}, {r["source"]: r["lang"] for r in known}
    total = float(total_tokens if total_tokens is not None else sizes.agg(F.sum("tokens")).first()[0] or 0)
    root = Node("all")
    for s, (w, m) in goals.items():
        root.add(path(s, tongue.get(s)), w, float(m * (per.get(s) or 0)))
    allot(root, total, total * root.weight)
    plan = []
    for p, leaf in root.leaves():
        if not p:
            continue
        s = p[-1]
        w, m = goals[s]
        n = per.get(s) or 0
        budget = int(leaf.budget + 1e-6)
        whole = min(m, budget // n) if n else 0
        plan.append((s, w, m, n, leaf.claim, m * n, leaf.short, budget, whole, budget - whole * n if whole < m else 0))
    spark = docs.sparkSession
    schema = "source string, weight double, max_uses long, size long, target double, capacity long, short boolean, budget long, whole long, part long"
    plan_df = spark.createDataFrame(plan, schema)
    small = F.broadcast(plan_df.select("source", "whole", "part"))  # one row per wanted source
    usable = sizes.where("tokens > 0").join(small, "source")
    whole = usable.where("whole > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "tokens")
    last = usable.where("part > 0").withColumn("u", uniform("doc_id", "whole", seed=seed))
    ranked = running_in_groups(last.select("doc_id", "source", F.col("whole").alias("epoch"), "part", "tokens", "u"), ["source"], "u", ["doc_id"], "tokens")
    prefix = ranked.where(F.col("cum") <= F.col("part")).select("doc_id", "source", "epoch", "tokens")
    rows = whole.unionByName(prefix)
    taken = prefix.groupBy("source").agg(F.sum("tokens").alias("t"))
    got = plan_df.join(taken, "source", "left").withColumn("tokens", F.col("whole") * F.col("size") + F.coalesce("t", F.lit(0)))
    all_ = got.agg(F.sum("tokens").cast("double").alias("all"))
    report = got.crossJoin(F.broadcast(all_)).withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.col("all")))  # one row each side
    return Mix(rows, report.select("source", "weight", "max_uses", "size", "target", "capacity", "short", "budget", "tokens", "share"))
