"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.check_queries import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert compare(df.collect(), df.columns, con, contract.oracle_sql()[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 1
