"""Audits on small frames with known defects."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import audit
from shelfmark.operators.clean import mark_gaps
from shelfmark.sources import schemas
from shelfmark.sources.shared import settle

D = Decimal


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, D("-2.00")), (2, D("0.00")), (3, D("4.00")), (4, D("6.00")), (5, None)]
    return spark.createDataFrame(rows, "id int, value decimal(10,2)")


def test_null_counts(numbers):
    got = {r.column_name: r.null_count for r in audit.null_counts(numbers).collect()}
    assert got == {"id": 0, "value": 1}


def test_orphans_name_their_issue(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    parent = spark.createDataFrame([("a",)], "k string")
    got = audit.orphans(child, parent, "k", "gone", ["id", "k"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(2, "b", "gone"), (3, None, "gone")]


@pytest.mark.parametrize("few_values", [True, False])
def test_profile(numbers, few_values):
    row = audit.profile_with_percentiles(
        numbers, "value", {"q1": 0.25, "median": 0.5}, few_values
    ).first()
    assert row.row_count == 5 and "whole_average" not in row
    assert (row.value_count, row.minimum, row.maximum) == (4, D("-2.00"), D("6.00"))
    assert row.average == 2.0 and row.deviation == pytest.approx((40 / 3) ** 0.5)
    assert (row.q1, row.median) == (-0.5, 2.0)


def test_whole_average_drops_the_fraction(spark):
    ages = spark.createDataFrame([(1,), (2,), (2,), (None,)], "age int")
    row = audit.profile(ages, "age").first()
    assert (row.row_count, row.value_count, row.whole_average) == (4, 3, 1)
    assert row.average == 5 / 3


def test_zero_has_no_sign(numbers):
    assert tuple(audit.sign_split(numbers, "value").first()) == (4, 1, 2, 25.0, 50.0)


def test_outside_band(numbers):
    labels = ("low", "high", "normal")
    got = audit.outside_band(numbers, "value", "id", (0, 5), labels).collect()
    assert [(r.id, r.band) for r in got] == [(1, "low"), (4, "high")]


def test_by_extreme_skips_null_and_orders_ties(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", None)], "id string, age int")
    got = audit.by_extreme(df, "age", "id", ["id", "age"]).collect()
    assert [r.id for r in got] == ["c", "a", "b"]


def test_value_counts_around_a_mapping(spark):
    before = spark.createDataFrame([("R1",), ("R6",), ("R6",)], "r string")
    after = spark.createDataFrame([("R1",), ("R1",), ("R1",)], "r string")
    got = {tuple(r) for r in audit.value_counts_around(before, after, "r").collect()}
    assert got == {("R1", 1, 3), ("R6", 2, 0)}


def test_duplicate_census_ignores_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert tuple(audit.duplicate_census(df, "k").first()) == (2, 1)
    assert tuple(audit.duplicate_census(df.filter("k = 'b'"), "k").first()) == (0, 0)


def test_cleaning_report(spark):
    raw = spark.createDataFrame([(1, None), (1, None), (2, 3), (3, None)], "k int, v int")
    marked = mark_gaps(raw.dropDuplicates(), ["v"]).withColumn("v", F.when(F.col("k") < 3, F.coalesce("v", "k")))
    clean, counts = audit.count_filled(marked, ["v"])
    clean = settle(clean, "counted")
    assert clean.columns == ["k", "v"]
    filled = {"t": counts.get["filled"]}
    rejects = spark.createDataFrame([("t", "k", "x"), ("u", "k", "x")], schemas.REJECTS)
    row = audit.cleaning_report(spark, {"t": (raw, clean, ["v"])}, filled, rejects).first()
    assert tuple(row) == ("t", 4, 3, 1, 3, 1, 1, 1)  # one of the doubled rows' NULLs was removed


def test_nothing_to_fill_counts_nothing(spark):
    for rows in ([], [(1,)]):
        df, counts = audit.count_filled(spark.createDataFrame(rows, "k int"), [])
        df.collect()
        assert counts.get["filled"] == 0


def test_counts(numbers):
    assert audit.count_present(numbers, "value").first()[0] == 4
    assert audit.row_count(numbers).first()[0] == 5
    assert tuple(audit.value_range(numbers, "id", "a", "b").first()) == (1, 5)
