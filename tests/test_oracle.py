import pytest

from cohortex.plans import catalog
from cohortex.staging import released
from oracle import same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    with released(spark):
        same(spark, small, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, small, name):
    """Queries without SQL have rows and no column that is null throughout."""
    with released(spark):
        rows = catalog.queries()[name](spark, small).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].asDict())
