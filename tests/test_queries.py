"""Every query with SQL gives DuckDB's rows; every other one runs."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

OWN = entry.QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf_dir, db, name):
    if name in entry.SQL:
        assert differences(spark, db, sf_dir, OWN[name], entry.SQL[name]) == ""
    else:
        assert OWN[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "cosine"]
