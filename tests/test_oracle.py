"""Every named query against its SQL, on the smallest tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, FOLDER, con, QUERIES[name], SQL[name]) is None


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r.outcome for r in rows} == {"win", "tie", "lose"}
