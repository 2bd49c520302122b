"""Every registered job against its DuckDB oracle, and at least one row from those without."""

import pytest

import __spark_entry__ as entry
from check import compare, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


# tables of the smallest scale may hold nothing that these look for
MAY_BE_EMPTY = {"f20_addresses_first_seen", "t06_select_series"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_matches_oracle(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, sf_dir, QUERIES[name], ORACLES.get(name))
    assert ok or (message == "no rows" and name in MAY_BE_EMPTY), message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
