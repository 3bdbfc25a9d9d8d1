"""Every registered query against its oracle SQL."""

import compare
import pytest

import __spark_entry__ as driver
from statledger.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    frame = driver.queries()[name](spark, sf_dir)
    assert compare.differences(frame, duck, driver.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
