"""Every registered query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, oracle_connection


@pytest.fixture(scope="module")
def oracle(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, small, oracle, name):
    df = queries()[name](spark, small)
    checks = oracle_sql()
    if name in checks:
        assert compare(df, oracle, checks[name]) == ""
    else:
        assert df.count() > 0


def test_every_check_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 10 and {"label", "accuracy", "n"} == set(rows[0].asDict())
