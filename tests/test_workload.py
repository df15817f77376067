"""Every registered query against its expected result, and the driver's contract."""

import __spark_entry__ as driver
import pytest
from check import compare, connect
from workload.oracles import ORACLES
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark, sf_dir):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, sf_dir, key):
    problem = compare(spark, con, sf_dir, QUERIES[key], ORACLES[key])
    assert problem is None, problem
