"""Every registered query against its SQL text on the smallest test tables."""

import pytest

from conftest import SMALL
from tools import check

import __spark_entry__ as entry
from tradeledger.plans import oracle, registered


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


def test_every_query_has_its_sql():
    assert set(registered.QUERIES) == set(oracle.sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, con, name):
    line = check.compare(spark, con, SMALL, name)
    assert line.startswith("ok"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
