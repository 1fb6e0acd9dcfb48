"""Queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from ticketlens.plans.catalog import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
