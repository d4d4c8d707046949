import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortex.llm.clusters import describe_clusters, markov_clusters, similar_groups, usual_levels
from cohortex.llm.sketches import Layout, add_values, decode, encode, invert, medians, merge_sketches, percentiles, sketch_fields, subtract_sketches


def test_codes_keep_order():
    x = np.array([-1e300, -7.5, -1e-300, -0.0, 0.0, 1e-300, 1.0, 1.0000021, 7.5, 1e300])
    c = encode(x, 32).astype(np.int64)
    assert (np.diff(c) >= 0).all() and c[3] == c[4]
    for part in ("lo", "mid", "hi"):
        assert np.allclose(decode(encode(x, 32), 32, part), x, rtol=2.0**-20, atol=1e-300)
    assert (decode(encode(x, 32), 32, "lo") <= x).all() and (decode(encode(x, 32), 32, "hi") >= x).all()


@pytest.mark.parametrize("kind", ["lognormal", "zeros", "uniform", "few"])
def test_rank_error_is_within_the_stated_bound(kind):
    rng = np.random.default_rng(7)
    n = 40_000
    x = {"lognormal": rng.lognormal(7, 1, n) * np.sign(rng.normal(size=n) + 0.6), "zeros": np.where(rng.random(n) < 0.6, 0, rng.lognormal(10, 0.4, n)), "uniform": rng.uniform(-5, 5, n), "few": np.round(rng.lognormal(1, 1, n))}[kind]
    lay = Layout()
    s = np.zeros(lay.size, np.int64)
    add_values(s, x, lay)
    xs = np.sort(x)
    for p in np.linspace(0.01, 0.99, 50):
        r = p * (n - 1) + 1
        lo, hi = np.searchsorted(xs, invert(s, n, r, lay, "lo"), "left"), np.searchsorted(xs, invert(s, n, r, lay, "hi"), "right")
        assert lo + 1 - lay.rank_error * n <= r <= hi + lay.rank_error * n


def frame(spark, n=3000):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, float("nan"), float("inf"), 0.0, rng.gauss(0, 100), rng.gauss(5, 1)]), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "g int, x double, y double").withColumn("w", F.lit("clash")).withColumn("grp", F.lit("clash")), rows


def test_medians_are_exact(spark):
    df, rows = frame(spark)
    got = {(r["grp"], r["field"]): r["median"] for r in medians(df, "g", ["x", "y"]).collect()}
    for g in (1, 2, None):
        for k, f in ((1, "x"), (2, "y")):
            vals = [r[k] for r in rows if r[0] == g and r[k] is not None and abs(r[k]) < float("inf")]
            assert got[None if g is None else str(g), f] == pytest.approx(median(vals))
    assert medians(df.limit(0), "g", ["x"]).count() == 0
    none = spark.createDataFrame([(1, None)], "g int, x double")
    assert medians(none, "g", ["x"]).count() == 0
    two = spark.createDataFrame([(1, 1.0), (1, 4.0)], "g int, x double")
    assert medians(two, "g", ["x"]).first()["median"] == 2.5


def test_medians_where_brackets_miss_or_values_heap_up(spark, monkeypatch):
    from cohortex.llm import sketches

    monkeypatch.setattr(sketches, "FEW", 20)
    rng = random.Random(12)
    values = {"1": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(501)], "2": [5.0] * 400 + [rng.gauss(5, 1e-6) for _ in range(300)], "3": [0.0] * 10, "4": [1.0, 2.0], "5": [rng.lognormvariate(8, 3) for _ in range(1000)]}
    df = spark.createDataFrame([(int(g), x) for g, xs in values.items() for x in xs], "g int, x double")
    wrong = spark.createDataFrame([(g, "x", lo, hi) for g, (lo, hi) in {"1": (-1e308, 1e308), "2": (70.0, 80.0), "3": (1.0, 2.0), "4": (-3.0, 1.5), "5": (0.0, 1.0)}.items()], "grp string, field string, lo double, hi double")
    got = {r["grp"]: (r["n"], r["median"]) for r in sketches.exact_medians(df, "g", ["x"], wrong).collect()}
    assert got == {g: (len(xs), pytest.approx(median(xs), rel=1e-12)) for g, xs in values.items()}


def test_jumps_against_exact_medians(spark, monkeypatch):
    from cohortex.llm import sketches

    rng = random.Random(13)
    rows, centre = [], {1: 100.0, 2: 149.0, 3: 75.5, 4: -75.0, 5: -74.0, 7: 0.0, 8: 0.0, 9: 3.0, 10: None, 11: 3.0, 12: 4.4999, 13: 6.7499}
    for g, c in centre.items():
        rows += [(g, None if c is None else c + rng.gauss(0, 1.0) * (abs(c) > 0), float(g)) for _ in range(301)]
    rows.append((None, 1e9, 1e9))
    df = spark.createDataFrame(rows, "g int, x double, y double").withColumn("field", F.lit("clash"))
    med = {(g, f): median([r[k] for r in rows if r[0] == g]) for g in centre for k, f in ((1, "x"), (2, "y")) if g != 10 or f == "y"}
    want = set()
    for f in ("x", "y"):
        for p, g in zip(list(centre), list(centre)[1:]):
            if (g, f) in med and (p, f) in med and abs(med[g, f] - med[p, f]) > abs(med[p, f]) / 2:
                want.add((g, f))
    measured = []
    monkeypatch.setattr(sketches, "exact_medians", lambda d, g, f, b, keep=sketches.exact_medians: measured.append(b.count()) or keep(d, g, f, b))
    got = {(r["g"], r["field"]) for r in sketches.median_jumps(df, "g", ["x", "y"], 0.5).collect()}
    assert got == want and 0 < sum(measured) < 2 * len(centre)
    assert sketches.median_jumps(df.limit(0), "g", ["x"], 0.5).count() == 0


def test_sketches_merge_and_forget(spark):
    df, _ = frame(spark)
    whole = {(r["grp"], r["field"]): (r["n"], bytes(r["cells"])) for r in sketch_fields(df, "g", ["x"]).collect()}
    a, b = df.where("y < 3"), df.where("y >= 3")
    sa, sb = sketch_fields(a, "g", ["x"]), sketch_fields(b, "g", ["x"])
    assert {(r["grp"], r["field"]): (r["n"], bytes(r["cells"])) for r in merge_sketches(sa.unionByName(sb)).collect()} == whole
    left = {r["grp"]: (r["n"], bytes(r["cells"])) for r in subtract_sketches(sketch_fields(df, "g", ["x"]), sb).collect()}
    assert left == {r["grp"]: (r["n"], bytes(r["cells"])) for r in sa.collect()}
    gone = sketch_fields(a.withColumn("sign", F.lit(1)).unionByName(a.withColumn("sign", F.lit(-1))), "g", ["x"], weight="sign")
    assert {r["n"] for r in gone.collect()} == {0} and percentiles(gone, [0.5]).count() == 0


def test_percentiles_bracket_the_truth(spark):
    df, rows = frame(spark)
    for r in percentiles(sketch_fields(df, "g", ["x"]), [0.1, 0.5, 0.9]).where("grp = '1'").collect():
        xs = sorted(x for g, x, _ in rows if g == 1 and x is not None and abs(x) < float("inf"))
        assert r["n"] == len(xs) and r["lo"] <= xs[round(r["p"] * (len(xs) - 1))] <= r["hi"]


def mcl(w, n, inflation=2.0, rounds=60):
    """Plain Markov clustering of a dense matrix with every record a node of its own."""
    owner = np.repeat(np.arange(len(n)), n)
    m = w[np.ix_(owner, owner)].copy()
    m /= m.sum(0)
    for _ in range(rounds):
        m = m @ m
        m = m**inflation
        m /= m.sum(0)
    best = np.array([np.flatnonzero(m[:, j] > m[:, j].max() * 0.99)[0] for j in range(len(owner))])
    return owner, owner[best]


def test_markov_clusters_against_dense_copies(spark):
    w = np.eye(7)
    for a, b, x in [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.8), (3, 4, 0.9), (2, 3, 0.05), (4, 5, 0.7), (3, 5, 0.7)]:
        w[a, b] = w[b, a] = x
    n = [4, 1, 2, 3, 5, 1, 2]
    nodes = spark.createDataFrame(list(enumerate(n)), "node long, n long")
    links = spark.createDataFrame([(a, b, float(w[a, b])) for a in range(7) for b in range(7) if a != b and w[a, b] > 0], "src long, dst long, w double")
    got = {r["node"]: r["cluster"] for r in markov_clusters(nodes, links, prune=1e-6).collect()}
    owner, best = mcl(w, n)
    want = {}
    for o, b in zip(owner, best):
        want.setdefault(int(o), int(b))
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want) == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({6})}


def test_flow_that_does_not_settle_is_an_error(spark):
    nodes = spark.createDataFrame([(k, 1) for k in range(30)], "node long, n long")
    links = spark.createDataFrame([(a, b, 1.0) for a in range(30) for b in (a - 1, a + 1) if 0 <= b < 30], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        markov_clusters(nodes, links, max_rounds=2)
    with pytest.raises(ValueError):
        markov_clusters(nodes, links, tolerance=0.1)


def test_groups_of_levels(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for k, (centre, count) in enumerate([(1000.0, 5), (-1000.0, 5), (40_000.0, 5), (1000.0, 9)]):
        for i in range(40):
            who = 100 * k + i
            truth[who] = k
            rows += [(who, centre * rng.uniform(0.85, 1.2), count) for _ in range(3)] + [(who, centre * 50, count), (who, None, None)][: rng.randrange(3)]
    rows += [(999, None, 3), (None, 5.0, 3), (998, float("nan"), 2), (997, 8.0, None), (996, None, None)]
    df = spark.createDataFrame(rows, "c long, x double, b int")
    levels = usual_levels(df, "c", ["x", "b"])
    members = similar_groups(levels, "c", "x", "b")
    got = {r["c"]: r["cluster"] for r in members.collect()}
    truth |= {999: "no amount", 998: "no amount", 997: "no count", 996: "nothing"}  # each kind of gap is a group
    assert set(got) == set(truth)
    assert len({(truth[c], got[c]) for c in got}) == 7 == len(set(got.values()))
    d = describe_clusters(members, "c").collect()
    assert sorted(r["size"] for r in d) == [1, 1, 2] + [40] * 4 and sum(r["size"] for r in d) == len(truth)
    assert all(truth[r["typical_1"]] == truth[r["typical_2"] or r["typical_1"]] for r in d)
    assert similar_groups(levels.limit(0), "c", "x", "b").count() == 0
