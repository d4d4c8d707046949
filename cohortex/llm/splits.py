"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from math import gcd, isqrt, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortex.llm.components import connected_components
from cohortex.operators.ranking import running_in_groups, uniform
from cohortex.staging import stage


def persons(counts: DataFrame, entity: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """The person of every entity: ``entity, person, n`` from ``entity, n`` rows (n records each; repeated entities add up)."""
    sizes = counts.groupBy(F.col(entity).alias("entity")).agg(F.sum("n").alias("n"))
    comp = connected_components(links, a, b).select(F.col("node").alias("entity"), "component")
    return stage(sizes.join(comp, "entity", "left").select("entity", F.coalesce("component", "entity").alias("person"), "n"), "persons")


def plan_splits(sizes: dict[int, int], shares: dict[str, float], max_bits: int = 1 << 12) -> dict[str, dict[int, int]]:
    """How many groups of each size go to each split so that the split totals come closest to ``shares``.

    sizes: how often each group size occurs.  Splits are filled from the
    smallest share to the largest, which takes the rest; each gets the reachable
    total nearest to its target (the lower of two equally near).  That holds for
    any number of records: see ``_closest``.  max_bits: the width of the first
    bitset that is tried; wider ones follow as long as they are needed.
    """
    total = sum(s * m for s, m in sizes.items())
    left = {s: m for s, m in sizes.items() if m > 0 and s > 0}
    weight = sum(shares.values())
    if weight <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must not be negative and must have a positive sum")
    order = sorted(shares, key=lambda k: (shares[k], k))
    plan: dict[str, dict[int, int]] = {k: {} for k in shares}
    for k in order[:-1]:
        plan[k] = _closest(left, total * shares[k] / weight, max_bits)
        for s, n in plan[k].items():
            left[s] -= n
    plan[order[-1]] = {s: m for s, m in left.items() if m}
    return plan


def _closest(left: dict[int, int], goal: float, bits: int) -> dict[int, int]:
    """How many groups of each size to take for the reachable total nearest to ``goal``.

    A first choice takes of every size its share, then whatever still fits, the
    largest first, and is off by less than the largest size S.  It is changed
    by a few groups of few sizes, by a bitset of the totals that this can reach.
    Common divisors of all sizes, or of all but a few groups, say which total
    is the nearest that can be (``_best_possible``); where that isn't reached, more groups of more sizes may change, until 4 S / g
    of each do, g being the divisor of all.  That is enough: of more than 3 S / g changes, put in an order
    that keeps their running sum within 3 S, two running sums are equal, and
    what is between them can be left out without changing the total.
    """
    rest = sum(s * m for s, m in left.items())
    take = {s: min(m, int(m * goal / rest)) for s, m in left.items()} if rest else {}
    at = sum(s * n for s, n in take.items())
    for s, m in sorted(left.items(), reverse=True):
        more = max(0, min(m - take[s], int((goal - at) // s)))
        take[s] += more
        at += s * more
    off = abs(goal - at)
    useful = {s: m for s, m in sorted(left.items()) if m and s <= goal + off}  # a larger group alone is further off
    g = gcd(*useful) or 1
    best = _best_possible(useful, goal, g)
    most = 4 * (max(useful, default=0) // g) + 2
    while at != best:
        change = _core(useful, take, bits * g, most)
        base = at - sum(s * down for s, (down, _) in change.items())
        parts = []  # (size, count)
        for s, (down, up) in sorted(change.items(), reverse=True):
            m, step = down + up, 1
            while m > 0:
                c = min(step, m)
                parts.append((s, c))
                m, step = m - c, step * 2
        chosen = _walk([s * c // g for s, c in parts], (goal - base) / g, int((goal + off - base) // g) + 2)
        moved = {s: take[s] - down for s, (down, _) in change.items()}
        for i in chosen:
            moved[parts[i][0]] += parts[i][1]
        near = base + sum(parts[i][0] * parts[i][1] for i in chosen)
        if near == best or all(c == (min(take[s], most), min(m - take[s], most)) for (s, m), c in zip(useful.items(), change.values())):
            return {s: n for s, n in (take | moved).items() if n}
        bits *= 4
    return {s: n for s, n in take.items() if n}


def _best_possible(sizes: dict[int, int], goal: float, g: int) -> int:
    """A total that no reachable one is nearer to ``goal`` than: a sum of the few groups whose size isn't a multiple of G, and a multiple of G, the largest divisor found that leaves at most 4,096 such sums."""
    big, ways = g, lambda d: prod(m + 1 for s, m in sizes.items() if s % d)
    for s in sorted(sizes, key=lambda s: -sizes[s])[:3]:
        rest, p = s // gcd(s, big), 2
        while rest > 1:
            p = p if p * p <= rest else rest
            while rest % p == 0:
                rest //= p
                big *= p if ways(big * p) <= 4096 else 1
            p += 1
    sums = {0}
    for s, m in sizes.items():
        if s % big:
            sums = {t + s * n for t in sums for n in range(m + 1)}
    even = sum(s * m for s, m in sizes.items() if s % big == 0)
    near = [o + big * min(even // big, max(0, int((goal - o) // big) + k)) for o in sums for k in (0, 1)]
    return min(near, key=lambda t: (abs(goal - t), t))


def _core(sizes: dict[int, int], take: dict[int, int], width: int, most: int) -> dict[int, tuple[int, int]]:
    """Of every size how many taken groups may be given back and how many others taken: one of each, then two, four, and so on up to ``most``, as long as ``width`` holds all of them; small sizes first."""
    change, n = dict.fromkeys(sizes, (0, 0)), 1
    while True:
        for s, m in sizes.items():
            now, then = change[s], (min(take[s], n), min(m - take[s], n))
            if (more := s * (sum(then) - sum(now))) <= width:
                width -= more
                change[s] = then
        if n >= most or n >= max(sizes.values()):
            return change
        n = min(2 * n, most)


def _walk(steps: list[int], goal: float, width: int) -> list[int]:
    """Places of ``steps`` whose sum is the reachable one nearest to ``goal``; totals from ``width`` on are not followed.

    Bit t of a bitset says that total t is reachable; a step is one shift-or.
    Of P bitsets only every sqrt(P)-th is kept; the walk back makes those of
    one stretch again at a time, so the driver holds 2 * sqrt(P) of them, not P.
    """
    cap = (1 << width) - 1
    stretch = max(1, isqrt(len(steps)))
    kept, reach = [], 1

    def with_step(bits: int, step: int) -> int:
        more = bits | bits << step
        return more & cap if more.bit_length() > width else more

    for i, step in enumerate(steps):
        if i % stretch == 0:
            kept.append(reach)
        reach = with_step(reach, step)
    t, chosen = _nearest(reach, goal), []
    for block in range(len(kept) - 1, -1, -1):
        lo = block * stretch
        made = [kept.pop()]
        for step in steps[lo : min(len(steps), lo + stretch) - 1]:
            made.append(with_step(made[-1], step))
        for i in range(lo + len(made) - 1, lo - 1, -1):
            if not made[i - lo] >> t & 1:
                chosen.append(i)
                t -= steps[i]
    return chosen


def _nearest(bits: int, goal: float) -> int:
    g = int(goal)
    below = (bits & ((1 << (g + 1)) - 1)).bit_length() - 1  # bit 0 is always set
    above = bits >> (g + 1)
    if above == 0:
        return below
    nxt = g + 1 + (above & -above).bit_length() - 1
    return below if goal - below <= nxt - goal else nxt


def assign_splits(groups: DataFrame, group: str, size: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``group, split`` for every row of ``groups`` (one row a group).

    Only the histogram of group sizes reaches the driver: d different sizes
    need d(d+1)/2 records, so it has at most sqrt(2 * records) rows.  Which
    groups of a size go where is decided by a seeded hash order, ranked in
    slices, because one size may be shared by most groups.
    """
    g = groups.select(F.col(group).alias("g"), F.col(size).cast("long").alias("size"))
    sizes = {r["size"]: r["m"] for r in g.groupBy("size").agg(F.count(F.lit(1)).alias("m")).collect()}
    plan = plan_splits(sizes, shares)
    spark = groups.sparkSession
    rows, names = [], sorted(shares)
    for s in sizes:
        at = 0
        for k in names:
            if n := plan[k].get(s, 0):
                rows.append((s, k, at, at + n))
                at += n
    quota = spark.createDataFrame(rows, "size long, split string, lo long, hi long")
    ranked = running_in_groups(g.withColumn("u", uniform("g", seed=seed)), ["size"], "u", ["g"])
    q = quota.withColumnRenamed("size", "qs")
    return ranked.join(q, (F.col("size") == F.col("qs")) & (F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi"))).select(F.col("g").alias(group), "split")


def split_records(records: DataFrame, entity: str, links: DataFrame, a: str, b: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``entity, person, n, split``: every entity of ``records`` with its split.

    All entities tied by ``links``, in either direction and over any number of
    steps, also through entities without records, are one person and share a
    split.  Records with a null entity belong to nobody and get no split; an
    empty table gives an empty result.  Repeated links change nothing.
    """
    counts = records.select(F.col(entity).alias("entity")).where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    who = persons(counts, "entity", links, a, b)
    per = who.groupBy("person").agg(F.sum("n").alias("size"))
    split = assign_splits(per, "person", "size", shares, seed)
    return who.join(split, "person").select(F.col("entity").alias(entity), "person", "n", "split")


def leaking_entities(records: DataFrame, entity: str, label: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """Entities of ``records`` whose person has records under two or more values of ``label`` (trimmed, lower case; null and blank left out)."""
    named = records.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.lower(F.trim(label)).alias("label"))
    seen = stage(named.groupBy("entity", "label").agg(F.count(F.lit(1)).alias("n")), "labels")
    who = persons(seen, "entity", links, a, b)
    labels = who.join(seen.where("label <> ''").select("entity", "label"), "entity")
    span = labels.groupBy("person").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("person")
    return who.join(span, "person", "left_semi").select(F.col("entity").alias(entity))
