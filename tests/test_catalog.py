"""Every registered query against its SQL."""

import pytest

from evidra.plans.catalog import QUERIES, SQL
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA).toPandas()
    wanted = duck.sql(SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows_of(found, columns) == rows_of(wanted, columns)


def test_queries_without_sql(spark):
    """All have SQL; a seeded sample is the same whenever it is taken, of its size, and has the forced row."""
    assert set(QUERIES) == set(SQL)
    a, b = ({r["o_orderkey"] for r in QUERIES["acceptance_sample"](spark, DATA).collect()} for _ in range(2))
    assert a == b and len(a) == 20 and 1 in a


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
