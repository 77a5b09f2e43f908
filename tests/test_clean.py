"""Cleaning operators on small frames written by hand."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import clean
from shelfmark.plans import cleaning
from shelfmark.sources import schemas


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


PEOPLE = "customer_id string, email string, signup_date date"


def merged(spark, *people):
    kept, mapping = cleaning.merge_customers(frame(spark, PEOPLE, *people))
    return [r.customer_id for r in kept.orderBy("customer_id").collect()], dict(
        tuple(r) for r in mapping.collect()
    )


def test_earliest_signup_survives_and_null_is_last(spark):
    kept, mapping = merged(
        spark,
        ("C1", "a@b.c", date(2022, 1, 1)),
        ("C2", "a@b.c", None),
        ("C3", "a@b.c", date(2021, 1, 1)),
    )
    assert kept == ["C3"]
    assert mapping == {"C1": "C3", "C2": "C3"}


def test_lowest_id_breaks_ties(spark):
    day = date(2022, 1, 1)
    assert merged(spark, ("C2", "a@b.c", day), ("C1", "a@b.c", day)) == (["C1"], {"C2": "C1"})
    assert merged(spark, ("C2", "a@b.c", None), ("C1", "a@b.c", None)) == (["C1"], {"C2": "C1"})


def test_null_emails_never_merge(spark):
    assert merged(spark, ("C1", None, None), ("C2", None, None)) == (["C1", "C2"], {})


def test_survivors_and_mapping_sources_are_all_ids(spark):
    people = spark.range(3000).select(
        F.concat(F.lit("C"), "id").alias("customer_id"),
        # a third share one address, a third have none, the rest pair up
        F.when(F.col("id") % 3 == 0, F.lit("hot@x.y"))
        .when(F.col("id") % 3 == 1, F.concat(F.floor(F.col("id") / 6), F.lit("@x.y")))
        .alias("email"),
        F.expr("date_add(date'2021-01-01', cast(id * 7 % 500 as int))").alias("signup_date"),
    )
    kept, mapping = cleaning.merge_customers(people)
    ids = {r.customer_id for r in kept.collect()}
    moves = {r[0]: r[1] for r in mapping.collect()}
    assert ids.isdisjoint(moves) and len(ids) + len(moves) == 3000
    assert set(moves.values()) <= ids
    assert kept.filter("email is null").count() == 1000
    assert kept.filter("email = 'hot@x.y'").count() == 1


def test_repoint_moves_mapped_ids_only(spark):
    orders = frame(spark, "order_id int, customer_id string", (1, "A"), (2, "B"), (3, None))
    mapping = frame(spark, "old_customer_id string, new_customer_id string", ("A", "Z"))
    moved = clean.repoint(orders, "customer_id", mapping)
    assert moved.columns == orders.columns
    assert rows(moved, "order_id") == [(1, "Z"), (2, "B"), (3, None)]


def test_hot_customer_is_split_when_repointed(spark):
    spark = spark.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }.items():
        spark.conf.set(key, value)
    orders = spark.range(60_000).repartition(8).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("customer_id"),
        F.xxhash64("id").alias("payload"),
    )
    mapping = spark.range(1, 5000, 2).select(
        F.col("id").alias("old_customer_id"), (F.col("id") - 1).alias("new_customer_id")
    )
    counted = clean.repoint(orders, "customer_id", mapping).agg(
        F.count("*"),
        F.count_if(F.col("customer_id") % 2 == 1),
        F.count_if(F.col("customer_id") == 0),
        F.max("payload"),
    )
    (row,) = counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert row[:2] == (60_000, 0) and row[2] > 20_000
    assert "SortMergeJoin(skew=true)" in plan


def test_fill_group_median(spark):
    people = frame(
        spark, "id int, country string, age int",
        (1, "BE", 20), (2, "BE", None), (3, "BE", 40), (4, "BE", 25), (5, "LU", None),
        (6, None, None), (7, None, 33), (8, "FR", 1), (9, "FR", 2), (10, "FR", None),
    )
    filled = {r.id: r.age for r in clean.fill_group_median(people, "age", "country").collect()}
    assert filled[2] == 25.0 and filled[10] == 1.5
    assert filled[5] is None and filled[6] is None and filled[7] == 33.0


def test_conform_passes_unknown_spellings_through(spark):
    df = frame(spark, "s string", ("LOW STOCK",), ("In stock",), ("odd",), (None,))
    got = {r.s for r in clean.conform(df, "s", cleaning.STOCK_STATUSES).collect()}
    assert got == {"Low Stock", "In Stock", "odd", None}


def test_products_impute_cost_with_all_digits(spark):
    raw = frame(
        spark, schemas.PRODUCTS,
        ("P1", "Chair", "home office", "desk-lamps", Decimal("57.35"), None, "S", "LOW STOCK"),
        ("P2", "Desk", "Furniture", "Desks", Decimal("10.00"), Decimal("6.00"), "S", "In stock"),
    )
    first, second = cleaning.clean_products(raw).orderBy("product_id").collect()
    assert first.cost_price == 40.144999999999996 and first.cost_price_imputed
    assert second.cost_price == 6.0 and not second.cost_price_imputed
    assert (first.category, first.subcategory) == ("Home Office", "Desk-Lamps")
    assert (first.stock_status, second.stock_status) == ("Low Stock", "In Stock")


LINES = schemas.ORDER_DETAILS


def line(key, order="O1", product="P1", quantity=2, discount="0.10", profit=None):
    return (
        key, order, product, quantity, discount and Decimal(discount), Decimal("0.21"),
        Decimal("21.78"), profit and Decimal(profit),
    )


@pytest.fixture(scope="module")
def prices(spark):
    return frame(
        spark, "product_id string, unit_price decimal(10,2), cost_price double",
        ("P1", Decimal("10.00"), 6.0), ("P2", Decimal("57.35"), 40.144999999999996),
        ("P3", Decimal("10.00"), None),
    )


def test_lowest_line_id_survives(spark):
    raw = frame(spark, LINES, line("L2"), line("L1"), line("L3", quantity=3), line("L4", "O2"))
    kept = cleaning.drop_duplicate_lines(raw)
    assert [r.order_detail_id for r in kept.orderBy("order_detail_id").collect()] == [
        "L1", "L3", "L4",
    ]


def test_missing_profit_is_recomputed_and_flagged(spark, prices):
    raw = frame(
        spark, LINES,
        line("L1"), line("L2", quantity=3, profit="-1.00"), line("L3", product="P2", discount=None),
        line("L4", product="P9"), line("L5", product="P3"), line("L6", quantity=1, profit="5.00"),
    )
    got = {
        r.order_detail_id: (r.discount, r.profit, r.is_loss_sale)
        for r in cleaning.clean_order_details(raw, prices).collect()
    }
    assert got["L1"] == (Decimal("0.10"), Decimal("6.00"), False)
    assert got["L2"][1:] == (Decimal("-1.00"), True)
    assert got["L3"] == (Decimal("0.00"), Decimal("34.41"), False)
    assert got["L4"][1:] == (None, False) and got["L5"][1:] == (None, False)
    assert got["L6"][1:] == (Decimal("5.00"), False)


def test_regions_merge_after_conforming(spark):
    raw = frame(
        spark, schemas.REGIONS,
        ("R1", "Spain", "Western Europe", "Ana Gil"), ("R2", "spain", "Western EU", "ana gil"),
        ("R3", "SPAIN", "western europe", "Ana Gil"), ("R4", "Spain", "Benelux", "Ana Gil"),
        ("R5", None, "Benelux", "Ana Gil"), ("R6", None, "Benelux", "Ana Gil"),
    )
    kept, mapping = cleaning.clean_regions(raw)
    assert rows(kept, "region_id") == [
        ("R1", "Spain", "Western Europe", "Ana Gil"), ("R4", "Spain", "Benelux", "Ana Gil"),
        ("R5", None, "Benelux", "Ana Gil"), ("R6", None, "Benelux", "Ana Gil"),
    ]
    assert rows(mapping, "old_region_id") == [("R2", "R1"), ("R3", "R1")]


def test_customers_end_to_end(spark):
    raw = frame(
        spark, schemas.CUSTOMERS,
        ("C1", "Ann", "Bo", "spain", "san-juan", "ann.bogmail.com", date(2022, 5, 1), "", 30),
        ("C2", "Ann", "Bo", "spain", "madrid", "ANN.BO@GMAIL.COM", date(2021, 5, 1), "Gold", None),
        ("C3", "Cy", "Do", "spain", "madrid", None, None, None, 41),
        ("C4", "Ed", "Fa", "spain", "madrid", "ed@host", None, "None", 20),
    )
    kept, mapping = cleaning.clean_customers(raw)
    got = {r.customer_id: r for r in kept.collect()}
    assert set(got) == {"C2", "C3", "C4"}
    assert rows(mapping, "old_customer_id") == [("C1", "C2")]
    # the merged-away row no longer counts in the median
    assert got["C2"].age == 30.5 and got["C2"].email_original == "ANN.BO@GMAIL.COM"
    assert got["C3"].loyalty_status == "Unclassified" and got["C4"].loyalty_status == "None"
    assert got["C3"].signup_date_missing and not got["C2"].signup_date_missing
    assert (got["C2"].country, got["C2"].city) == ("Spain", "Madrid")
    assert got["C4"].email is None and got["C4"].email_original == "ed@host"


def test_loyalty_tokens_can_mean_missing(spark):
    raw = frame(spark, schemas.CUSTOMERS, ("C1", "A", "B", "x", "y", None, None, "None", 30))
    kept, _ = cleaning.clean_customers(raw, na_tokens=("", "None"))
    assert kept.first().loyalty_status == "Unclassified"


def test_orders_repoint_before_median_by_conformed_mode(spark):
    def order(key, customer, region, mode, days, pay="visa", priority="LOW"):
        return (key, date(2024, 1, 1), customer, region, mode, pay, days, Decimal("1.00"), priority)

    raw = frame(
        spark, schemas.ORDERS,
        order("O1", "C1", "R2", "express", 1), order("O2", "C2", "R1", "EXPRESS", 2),
        order("O3", "C3", "R9", "Express", None, "ideal", "urgent"),
        order("O4", "C3", "R9", "OVERNIGHT", None, "cash", "odd"),
    )
    customers = frame(spark, schemas.CUSTOMER_MAPPING, ("C1", "C2"))
    regions = frame(spark, schemas.REGION_MAPPING, ("R2", "R1"))
    done = cleaning.clean_orders(raw, customers, regions).orderBy("order_id").collect()
    assert [(r.customer_id, r.region_id) for r in done] == [
        ("C2", "R1"), ("C2", "R1"), ("C3", "R9"), ("C3", "R9"),
    ]
    assert [r.ship_mode for r in done] == ["Express"] * 3 + ["OVERNIGHT"]
    assert [r.delivery_time_days for r in done] == [1.0, 2.0, 1.5, None]
    assert [r.payment_method for r in done] == ["Visa", "Visa", "iDEAL", "cash"]
    assert [r.order_priority for r in done] == ["Low", "Low", "Urgent", "odd"]
