"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from compare import DATA, spark_rows, sql_rows
from tidewrack.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship_has_rows(spark):
    found = registry.flagship(spark, DATA)
    assert found.count() > 0 and "pos" in found.columns
