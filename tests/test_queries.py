"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, name):
    status, message, _ = compare(spark, con, SF, name, QUERIES[name], CHECKS[name])
    assert status == "ok", message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
