"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import oracle_check
from loomery import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.load()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    assert oracle_check.compare(got, con.execute(SQL[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert isinstance(duckdb.__version__, str)
