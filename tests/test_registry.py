"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from conftest import SMALL
from tenderlake.plans import oracle, registry


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(oracle.QUERIES) == set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) is None
