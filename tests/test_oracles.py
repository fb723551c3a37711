"""Every registered query against its SQL on the smallest data set, and its plan."""

import pytest

import __spark_entry__ as entry
from suite.check import compare, oracle

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    """Equal to its SQL, and planned without a join of all pairs."""
    frame = entry.queries()[name](spark, SF)
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        cursor = connection.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        difference = compare(frame.columns, rows, names, cursor.fetchall())
        assert difference is None, difference


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
