"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


def test_only_training_data_queries_have_no_sql():
    assert all(n == "pipeline" or n.startswith("op") for n in QUERIES if n not in SQL)


def test_entry(spark):
    assert entry(spark).count() > 0
