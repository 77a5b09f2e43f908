"""Revenue and profitability questions over the sales fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import growth_percent, margin_percent, ratio


def revenue_and_profit(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys).agg(
        F.sum("revenue").alias("total_revenue"), F.sum("profit").alias("total_profit")
    )


def by_year(fact: DataFrame) -> DataFrame:
    """Revenue, profit, orders and average order value by year."""
    orders = F.countDistinct("order_id")
    return (
        fact.groupBy("order_year")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("profit").alias("total_profit"),
            orders.alias("order_count"),
            ratio(F.sum("revenue"), orders).alias("avg_order_value"),
        )
        .orderBy(F.desc("order_year"))
    )


def by_quarter(fact: DataFrame) -> DataFrame:
    keys = ["order_year", "order_quarter"]
    return revenue_and_profit(fact, *keys).orderBy(*(F.desc(k) for k in keys))


def by_month(fact: DataFrame) -> DataFrame:
    keys = ["order_year", "order_month"]
    return revenue_and_profit(fact, *keys).orderBy(*(F.desc(k) for k in keys))


def margins(fact: DataFrame, *keys: str) -> DataFrame:
    """Profit, revenue and margin per group: sums first, then the ratio."""
    return fact.groupBy(*keys).agg(
        F.sum("profit").alias("total_profit"),
        F.sum("revenue").alias("total_revenue"),
        margin_percent().alias("profit_margin_pct"),
    )


def margin_by_category(fact: DataFrame) -> DataFrame:
    return margins(fact, "product_category").orderBy(F.desc("profit_margin_pct"))


def margin_by_country(fact: DataFrame) -> DataFrame:
    return margins(fact, "region_id", "region_country").orderBy(F.desc("profit_margin_pct"))


def yearly_growth(fact: DataFrame) -> DataFrame:
    """Growth against the previous year; only years reach the window."""
    years = fact.groupBy("order_year").agg(F.sum("revenue").alias("current_revenue"))
    previous = F.lag("current_revenue").over(Window.orderBy("order_year"))
    return years.withColumn("previous_revenue", previous).withColumn(
        "growth_pct", growth_percent(F.col("current_revenue"), F.col("previous_revenue"))
    )
