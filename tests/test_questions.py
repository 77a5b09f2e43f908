"""Business questions: edge cases on small facts, and invariants on real ones."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import tables_of
from shelfmark.plans import customers, operations, products, regions, revenue, time_series

SF = "/root/testdata/sf0.001"
D = Decimal


@pytest.fixture(scope="module")
def shop(spark):
    return tables_of(spark, SF).shop


def test_discount_classes(spark):
    discounts = ["0.00", "0.10", "0.11", "0.20", "0.30", "0.35", None]
    rows = [(d and D(d), d is not None and D(d) > 0, 1, D(10), D(1)) for d in discounts]
    fact = spark.createDataFrame(
        rows,
        "discount decimal(5,2), is_discounted boolean, quantity int, revenue decimal(10,2), "
        "profit decimal(10,2)",
    )
    got = {r.discount_range: r.line_count for r in customers.discount_effect(fact).collect()}
    assert got == {"No Discount": 1, "1-10%": 1, "11-20%": 2, "21-30%": 1, None: 1}


def test_churn_bounds(spark):
    today = date(2025, 11, 5)
    rows = [(n, today - timedelta(n)) for n in (30, 31, 90, 91, 180, 181)]
    fact = spark.createDataFrame(rows, "customer_id int, order_date date")
    counted = customers.churn(fact, F.lit(today)).collect()
    got = {r.customer_status: r.customer_count for r in counted}
    assert got == {
        "Active (0-30 days)": 1, "Recent (30-90 days)": 2, "At Risk (90-180 days)": 2,
        "Churned (180+ days)": 1,
    }


def test_on_time_limits(spark):
    rows = [("Overnight", 1), ("Overnight", 2), ("Overnight", None), ("Economy", 14), ("Odd", 1)]
    orders = spark.createDataFrame(rows, "ship_mode string, delivery_time_days int")
    row = operations.on_time(orders).first().asDict()
    assert (row["overnight_deliveries"], row["on_time_overnight"]) == (3, 1)
    assert (row["economy_deliveries"], row["on_time_economy"]) == (1, 1)
    assert (row["express_deliveries"], row["on_time_express"]) == (0, 0)


def test_delivery_days_exact_and_whole(spark):
    fact = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("b", None)], "ship_mode string, delivery_time_days int"
    )
    got = {r.ship_mode: tuple(r)[1:] for r in operations.delivery_days(fact, "ship_mode").collect()}
    assert got == {"a": (5 / 3, 1), "b": (None, None)}


def sales(spark, *rows):
    return spark.createDataFrame(
        [(y, m, (m + 2) // 3, str(m), D(r)) for y, m, r in rows],
        "order_year int, order_month int, order_quarter int, order_month_name string, "
        "revenue decimal(10,2)",
    )


def test_growth_skips_gaps_and_guards_zero(spark):
    fact = sales(spark, (2020, 1, 0), (2022, 1, 10), (2023, 1, 15))
    got = {r.order_year: r.growth_pct for r in revenue.yearly_growth(fact).collect()}
    assert got == {2020: None, 2022: None, 2023: 50.0}


def test_moving_average_is_short_at_the_start(spark):
    fact = sales(spark, (2023, 11, 1), (2023, 12, 2), (2024, 1, 6), (2024, 3, 7))
    got = [r.moving_avg for r in time_series.moving_average(fact).collect()]
    assert got == [1.0, 1.5, 3.0, 5.0]


def test_partial_quarters_are_left_out(spark):
    fact = sales(spark, (2022, 10, 1), (2023, 1, 2), (2023, 2, 3), (2025, 12, 4))
    got = [tuple(r) for r in time_series.complete_quarters(fact).collect()]
    assert got == [(2023, 1, D("5.00"), 2)]
    assert time_series.complete_quarters(fact, ()).count() == 3


def test_quarterly_growth_rounds_before_averaging(spark):
    fact = sales(spark, (2023, 1, 3), (2023, 4, 4), (2023, 7, 5))
    assert time_series.average_quarterly_growth(fact).first()[0] == (33.33 + 25.0) / 2
    assert time_series.average_monthly_growth(fact).first()[0] == (100 / 3 + 25) / 2


def test_same_month_needs_the_same_month(spark):
    from shelfmark.operators.star import calendar_of

    rows = [(date(2023, 5, 1), D(1)), (date(2023, 6, 1), D(2)), (date(2024, 5, 9), D(3))]
    fact = spark.createDataFrame(rows, "order_date date, revenue decimal(10,2)")
    got = {
        (r.year, r.month): r.same_month_last_year
        for r in time_series.same_month_last_year(fact, calendar_of(fact)).collect()
    }
    assert got == {(2023, 5): None, (2023, 6): None, (2024, 5): D("1.00")}


def test_shares_add_up(shop):
    parts = (
        (regions.country_shares(shop.fact), "country_share_pct", 0.2),
        (products.stock_status_shares(shop.fact, shop.products), "pct_of_revenue", 0.02),
        (products.cross_selling(shop.fact), "pct_of_orders", 1e-6),
        (customers.churn(shop.fact), "pct_customers", 1e-6),
        (customers.value_quintiles(shop.fact), "pct_of_revenue", 1e-6),
    )
    for df, column, slack in parts:
        assert df.agg(F.sum(column)).first()[0] == pytest.approx(100, abs=slack)


def test_quintile_sizes_differ_by_at_most_one(shop):
    sizes = [r.customer_count for r in customers.value_quintiles(shop.fact).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_allocated_shipping_adds_up_to_the_order_amount(shop):
    allocated = shop.fact.groupBy("order_id").agg(
        F.sum("shipping_cost").alias("sum"), F.count("*").alias("lines")
    )
    off = allocated.join(shop.orders, "order_id").filter(
        F.abs(F.col("sum") - F.col("shipping_cost")) > F.col("lines") * F.lit(D("0.005"))
    )
    assert off.count() == 0


def test_top_and_bottom_are_ranked(shop):
    best = products.extreme_products(shop.fact, shop.products, 5).collect()
    assert [r.profit_rank for r in best] == [1, 2, 3, 4, 5]
    assert [r.total_profit for r in best] == sorted((r.total_profit for r in best), reverse=True)
    worst = products.extreme_products(shop.fact, shop.products, 5, best=False).collect()
    assert [r.total_profit for r in worst] == sorted(r.total_profit for r in worst)


def test_revenue_tree_levels_agree(shop):
    tree = regions.revenue_tree(shop.fact)
    summed = tree.groupBy("level").agg(F.sum("total_revenue").alias("s"))
    levels = {r.level: r.s for r in summed.collect()}
    assert set(levels) == {0, 1, 3, 7} and len(set(levels.values())) == 1


def test_cohorts_start_with_all_their_customers(shop):
    cohorts = customers.cohort_retention(shop.fact)
    first = cohorts.filter("months_since = 0").agg(F.sum("active_customers")).first()[0]
    assert first == shop.fact.select("customer_id").distinct().count()


def test_lines_of_a_product_without_a_name(spark):
    fact = spark.createDataFrame(
        [(1, 5, 9, "Pens", 2.0), (1, 4, 8, "Pens", -1.0), (2, 4, 7, "Ink", 3.0), (3, 1, 1, "Ink", 4.0)],
        "product_id int, order_id int, order_detail_id int, product_category string, profit double",
    )
    known = spark.createDataFrame([(1, None), (2, "Ink")], "product_id int, product_name string")

    def lines(product):
        found = products.lines_of_product(fact, known, product).collect()
        return [(r.order_detail_id, r.product_name) for r in found]

    assert lines(1) == [(8, None), (9, None)]
    assert lines(2) == [(7, "Ink")]
    assert lines(3) == lines(4) == []
