"""w8_trend against brute force: every client, the shared number too."""

from math import log1p

import pytest

from cohortex.plans import catalog
from cohortex.plans.base import monthly

SHARED = 40000001


def slope(points):
    known = [(float(x), float(y)) for x, y in points if x is not None and y is not None]
    if len({x for x, _ in known}) < 2:
        return None
    mx, my = (sum(v) / len(known) for v in zip(*known))
    return sum((x - mx) * (y - my) for x, y in known) / sum((x - mx) ** 2 for x, _ in known)


def test_trend_of_every_client(spark, small):
    rows = {(r["c"], r["t"]): (r["antig"], r["saldo"]) for r in monthly(spark, small, "saldo", "antig").collect()}
    periods = sorted({t for _, t in rows})
    got = {(r["c"], r["t"]): r["pendiente"] for r in catalog.queries()["w8_trend"](spark, small).collect()}
    assert set(got) == set(rows) and SHARED in {c for c, _ in got}
    for (c, t), v in got.items():
        k = periods.index(t)
        b = slope([rows.get((c, p), (None, None)) for p in periods[max(0, k - 3) : k + 1]])
        want = None if b is None else (1 if b > 0 else -1 if b < 0 else 0) * log1p(abs(b))
        assert v == (want if want is None else pytest.approx(want, abs=2e-6)), (c, t)
