"""Every registered query beside its SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import check, duck

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    ok, message = check(spark, con, name, queries()[name], oracle_sql().get(name), sf_dir)
    assert ok, message


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["group_id", "n", "mean", "std", "lo", "hi"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
