"""The sales fact and the calendar."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import audit, star
from shelfmark.sources import schemas
from shelfmark.sources.tables import write_fact

D = Decimal


@pytest.fixture(scope="module")
def base(spark):
    def df(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return {
        "lines": df(
            schemas.ORDER_DETAILS,
            ("L1", "O1", "P1", 1, D("0.00"), D("0.21"), D("30.00"), D("3.00")),
            ("L2", "O1", "P2", 6, D("0.10"), D("0.21"), D("70.00"), D("-7.00")),
            ("L3", "O2", "P1", 2, None, D("0.21"), D("600.00"), None),
            ("L4", "O3", "P1", 2, D("0.00"), D("0.21"), D("0.00"), D("1.00")),
            ("L5", "O9", "P1", 2, D("0.00"), D("0.21"), D("9.00"), D("1.00")),
            ("L6", "O1", "P9", 2, D("0.00"), D("0.21"), D("100.00"), D("1.00")),
            ("L7", "O4", "P1", 2, D("0.00"), D("0.21"), D("9.00"), D("1.00")),
        ),
        "orders": df(
            schemas.ORDERS,
            ("O1", date(2024, 2, 29), "C1", "R1", "Express", "Visa", 2, D("20.00"), "High"),
            ("O2", date(2023, 12, 31), "C2", "R1", "Economy", "Visa", None, D("5.00"), "Low"),
            ("O3", date(2024, 1, 1), "C1", "R1", "Economy", "Visa", 7, D("5.00"), "Low"),
            ("O4", date(2024, 1, 1), "C1", "R9", "Economy", "Visa", 7, D("5.00"), "Low"),
        ),
        "customers": df(
            schemas.CUSTOMERS,
            ("C1", "Ann", "Bo", "Spain", "Madrid", None, None, "Gold", 30),
            ("C2", "Cy", None, "Spain", "Madrid", None, None, "Silver", 30),
        ),
        "products": df(
            schemas.PRODUCTS,
            ("P1", "Pen", "Office", "Pens", D("15.00"), D("9.00"), "S1", "In Stock"),
            ("P2", "Mug", "Home", "Cups", D("12.00"), None, "S2", "Low Stock"),
        ),
        "regions": df(schemas.REGIONS, ("R1", "Portugal", "South", "Eva")),
    }


@pytest.fixture(scope="module")
def fact(base):
    built = star.build_fact_sales(**base)
    return {r.order_detail_id: r for r in built.collect()}


def test_lines_with_a_missing_key_drop_out(fact):
    assert set(fact) == {"L1", "L2", "L3", "L4"}


def test_shipping_is_allocated_over_all_lines_of_the_order(fact):
    # L6 has no product, yet its 100.00 counts in the order total of 200.00
    assert fact["L1"].shipping_cost == D("3.00") and fact["L2"].shipping_cost == D("7.00")
    assert fact["L4"].shipping_cost is None  # order total 0


def test_measures(fact):
    second = fact["L2"]
    assert (second.gross_amount, second.discount_amount) == (D("72.00"), D("7.20"))
    assert second.cost is None and fact["L1"].cost == D("9.00")
    assert second.profit_margin == D("-0.1000")
    assert fact["L4"].profit_margin is None and fact["L3"].profit_margin is None


def test_flags_treat_unknown_as_no(fact):
    flags = ("is_loss_sale", "is_discounted", "is_high_value", "is_bulk_order")
    assert [fact["L2"][f] for f in flags] == [True, True, False, True]
    assert [fact["L3"][f] for f in flags] == [False, False, True, False]


def test_dates_and_attributes(fact):
    first = fact["L1"]
    assert (first.order_year, first.order_quarter, first.order_month) == (2024, 1, 2)
    assert (first.order_month_name, first.order_day, first.order_day_name) == (
        "February", 29, "Thursday",
    )
    assert first.region_country == "Portugal"  # of the region, not of the customer
    assert first.customer_full_name == "Ann Bo" and fact["L3"].customer_full_name is None
    assert list(first.asDict()) == star.FACT_COLUMNS


def test_profit_expression_replaces_the_column(base):
    built = star.build_fact_sales(**base, profit=F.col("revenue") - F.lit(1))
    assert built.filter("order_detail_id = 'L1'").first().profit == D("29.00")


def test_rebuilding_the_fact_replaces_it(spark, base, tmp_path):
    built = star.build_fact_sales(**base)
    for _ in range(2):
        write_fact(built, str(tmp_path / "fact"))
    again = spark.read.schema(built.schema).parquet(str(tmp_path / "fact"))
    assert again.count() == 4
    assert {p.name for p in (tmp_path / "fact").glob("order_year=*")} == {
        "order_year=2023", "order_year=2024",
    }
    assert audit.load_check(again).first().total_revenue == D("700.00")


def test_hot_order_and_product_are_split_and_right(spark):
    """A third of the lines in one order and a third on one product, joins shuffled."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    spark = spark.newSession()
    for key, value in changed.items():
        spark.conf.set(key, value)
    ids = spark.range(30_000).repartition(8)
    key = F.col("id")
    lines = ids.select(
        key.alias("order_detail_id"),
        F.when(key % 3 == 0, 7).otherwise(key % 5000).alias("order_id"),
        F.when(key % 3 == 1, 9).otherwise(key % 400).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit(0).cast("decimal(5,2)").alias("discount"),
        F.lit(0).cast("decimal(5,2)").alias("tax_rate"),
        (key % 90 + 10).cast("decimal(10,2)").alias("total_price"),
        F.lit(1).cast("decimal(10,2)").alias("profit"),
    )
    orders = spark.range(5000).select(
        F.col("id").alias("order_id"),
        F.lit(date(2024, 1, 1)).alias("order_date"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 100).alias("customer_id"),
        (F.col("id") % 2).alias("region_id"),
        F.lit("Express").alias("ship_mode"),
        F.lit("Visa").alias("payment_method"),
        F.lit(1).alias("delivery_time_days"),
        F.lit(1000).cast("decimal(10,2)").alias("shipping_cost"),
        F.lit("Low").alias("order_priority"),
    )
    customers = spark.range(100).selectExpr(
        "id as customer_id", "'Ann' as first_name", "'Bo' as last_name", "'Gold' as loyalty_status"
    )
    products = spark.range(400).selectExpr(
        "id as product_id", "cast(20 as decimal(10,2)) as unit_price",
        "cast(10 as decimal(10,2)) as cost_price", "'c' as category", "'s' as subcategory",
        "'u' as supplier",
    )
    regions = spark.range(2).selectExpr(
        "id as region_id", "'x' as country", "'n' as region_name", "'m' as manager"
    )
    fact = star.build_fact_sales(lines, orders, customers, products, regions)
    summed = fact.agg(F.count("*"), F.sum("cost"), F.max("region_name"), F.sum("revenue"))
    (row,) = summed.collect()
    plan = summed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    one = fact.filter("order_id = 7").agg(F.sum("shipping_cost"), F.count("*")).first()
    expected = sum(i % 90 + 10 for i in range(30_000))
    assert (row[0], row[1], row[3]) == (30_000, D(300_000), D(expected))
    assert plan.count("SortMergeJoin(skew=true)") == 2
    assert one[1] > 10_000 and abs(one[0] - D(1000)) < D("0.005") * one[1]


def test_calendar(spark):
    days = {r.full_date: r for r in star.dim_date(spark).collect()}
    assert len(days) == 1826
    first, third = days[date(2021, 1, 1)], days[date(2021, 1, 3)]
    assert (first.date_key, first.week_of_year, first.day_of_week) == (20210101, 1, 6)
    assert not first.is_weekend and first.is_weekday
    assert (third.week_of_year, third.day_of_week, third.is_weekend) == (2, 1, True)
    leap = days[date(2024, 2, 29)]
    assert (leap.quarter_name, leap.month_name_short, leap.month_year, leap.year_name) == (
        "Q1", "Feb", "February 2024", "2024",
    )
    assert (leap.day_name, leap.day_name_short) == ("Thursday", "Thu")


def test_overwrite_from_keeps_unmatched_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    dim = spark.createDataFrame([(1, "z")], "k int, name string")
    got = star.overwrite_from(df, dim, "k", "v", F.col("name")).collect()
    assert sorted(r.v for r in got) == ["b", "c", "z"]
