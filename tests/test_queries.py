"""Every registered query against DuckDB on the benchmark tables."""

import os

import pytest

import __spark_entry__ as contract
from paylens.workloads import catalog
from tests.oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    assert differences(contract.queries()[name](spark, FOLDER), duck, contract.oracle_sql()[name]) == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["id", "salary", "cpi", "real_salary"]
    assert result.count() > 0
