"""Length limits: those of a small part of a source, and several of one."""

import random

from cohortex.llm.truncation import Options, cut_records, length_limits, source_rates

SCHEMA = "of long, source string, chars int, size int, ending string, z double"


def spread(rng, source, n, low, high):
    """Whole texts of all lengths, a few of which look cut."""
    return [(0, source, c, c + rng.randrange(3), "ended", 1.0 if rng.random() < 0.05 else -1.0) for c in (rng.randrange(low, high) for _ in range(n))]


def at(source, chars, n, open_, size=lambda i: 0):
    return [(0, source, chars, chars + size(i), "open", 1.0 if i < open_ else -1.0) for i in range(n)]


def limits(spark, rows):
    return {(s, m, k) for s, m, k, *_ in length_limits(spark.createDataFrame(rows, SCHEMA), Options())}


def test_limit_of_a_small_share(spark):
    rng = random.Random(4)
    rows = spread(rng, "big", 20_000, 100, 4_100) + at("big", 3_000, 150, 120, lambda i: i % 40)  # 0.8 % of the source
    rows += spread(rng, "form", 20_000, 100, 4_100) + at("form", 2_000, 150, 8, lambda i: i % 40)  # as many whole texts of one length
    rows += spread(rng, "even", 20_000, 100, 4_100)
    assert limits(spark, rows) == {("big", "chars", 3_000)}


def test_closed_cuts_at_a_rare_limit(spark):
    from test_text import sentences

    rng = random.Random(21)
    rows, full = [], []
    for i in range(3_000):
        t = sentences(rng)
        if i % 75 == 0:
            t = (t + " " + sentences(rng) + " " + sentences(rng))[:400]
            full.append(i)
        rows.append((i, "uno", t))
    got = {r["doc_id"]: r for r in cut_records(spark.createDataFrame(rows, "d long, s string, t string"), "d", "t", "s", None, Options(rounds=60)).collect()}
    assert len(full) < 0.02 * len(rows) and {r["limit"] for r in got.values()} == {400}
    hit = sum(got[i]["cut"] for i in full)
    assert hit >= 0.9 * len(full)


def test_all_limits_of_a_source(spark):
    rng = random.Random(5)
    rows = spread(rng, "two", 8_000, 100, 4_100) + at("two", 1_000, 120, 110, lambda i: i % 40) + at("two", 1_005, 60, 55, lambda i: i % 40)  # the limit was moved
    rows += [(0, "two", 3_000 - i % 45, 3_000 - (i % 4 if i % 3 == 0 else 0), "open", 1.0) for i in range(90)]  # and a limit in bytes, cut between characters
    rows += spread(rng, None, 2_000, 100, 4_100) + at(None, 500, 40, 40, lambda i: i % 20)  # in characters: the sizes differ
    assert limits(spark, rows) == {("two", "chars", 1_000), ("two", "chars", 1_005), ("two", "size", 3_000), (None, "chars", 500)}


def test_closed_cuts_at_every_limit(spark):
    from test_text import sentences

    rng = random.Random(22)
    rows, full = [], {400: [], 700: []}
    for i in range(2_000):
        t = sentences(rng)
        if i % 10 == 0:
            k = 400 if i % 30 else 700
            t = " ".join([t] + [sentences(rng) for _ in range(6)])[:k]
            full[k].append(i)
        rows.append((i, "uno", t))
    docs = spark.createDataFrame(rows, "d long, s string, t string")
    records = cut_records(docs, "d", "t", "s", None, Options(rounds=60))
    got = {r["doc_id"]: r for r in records.collect()}
    assert len(got) == len(rows)
    for k, ids in full.items():
        assert {got[i]["limit"] for i in ids} == {k} and sum(got[i]["cut"] for i in ids) >= 0.9 * len(ids)
        closed = [i for i in ids if rows[i][2].endswith(".")]
        assert all(got[i]["cut"] for i in closed)
    assert [r["limits"] for r in source_rates(records).collect()] == [[400, 700]]
