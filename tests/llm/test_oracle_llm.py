import pytest

from cohortex.llm import queries
from cohortex.staging import released
from oracle import same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    with released(spark):
        same(spark, small, queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(spark, small, name):
    """Queries without SQL have rows and no column that is null throughout, but for length limits, which these few rows do not show."""
    with released(spark):
        rows = queries.queries()[name](spark, small).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].asDict() if c != "limit")
