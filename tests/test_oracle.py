"""Every registered query equals its SQL, value by value, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import statements
from shelfmark.catalog import QUESTIONS
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUESTIONS) == statements().keys()
    assert set(QUESTIONS) <= entry.queries().keys()


@pytest.mark.parametrize("name", QUESTIONS)
def test_rows_equal(spark, con, name):
    assert difference(spark, con, name, SF) is None


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "order_year", "total_revenue", "total_profit", "order_count", "avg_order_value",
    ]
