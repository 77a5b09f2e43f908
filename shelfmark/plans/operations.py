"""Delivery and shipping questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.measures import mean, percent, percent_of_all, whole_mean

# Days within which an order of each ship mode is on time.
DELIVERY_LIMITS = {"Overnight": 1, "Express": 3, "Standard": 10, "Economy": 14}


def delivery_days(fact: DataFrame, key: str) -> DataFrame:
    """Average delivery days of the lines by ``key``.

    The exact average, and its whole days.
    """
    return (
        fact.groupBy(key)
        .agg(
            mean("delivery_time_days").alias("avg_delivery_days"),
            whole_mean("delivery_time_days").alias("whole_delivery_days"),
        )
        .orderBy("avg_delivery_days")
    )


def on_time(orders: DataFrame, limits: dict[str, int] = DELIVERY_LIMITS) -> DataFrame:
    """One row: orders of each ship mode and those delivered within its limit.

    An order without delivery days is not on time.
    """
    of_mode = {m: F.col("ship_mode") == m for m in limits}
    return orders.agg(
        *(F.count_if(test).alias(f"{m.lower()}_deliveries") for m, test in of_mode.items()),
        *(
            F.count_if(test & (F.col("delivery_time_days") <= limits[m])).alias(
                f"on_time_{m.lower()}"
            )
            for m, test in of_mode.items()
        ),
    )


def shipping_share_by_order(fact: DataFrame) -> DataFrame:
    """Shipping cost as a percentage of the gross value of each order."""
    return (
        fact.groupBy("order_id")
        .agg(
            F.sum("gross_amount").alias("order_value"),
            F.sum("shipping_cost").alias("order_shipping_cost"),
        )
        .withColumn("shipping_pct", percent(F.col("order_shipping_cost"), F.col("order_value")))
        .orderBy(F.desc("shipping_pct"), "order_id")
    )


def shipping_share(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.sum("shipping_cost").alias("total_shipping_cost"),
        F.sum("gross_amount").alias("total_order_value"),
        percent(F.sum("shipping_cost"), F.sum("gross_amount")).alias("shipping_pct"),
    )


def shipping_by_mode(fact: DataFrame) -> DataFrame:
    """Orders, shipping cost and its share of gross value by ship mode."""
    return (
        fact.groupBy("ship_mode")
        .agg(
            F.countDistinct("order_id").alias("order_count"),
            F.sum("shipping_cost").alias("total_shipping_cost"),
            mean("shipping_cost").alias("avg_line_shipping_cost"),
            percent(F.sum("shipping_cost"), F.sum("gross_amount")).alias("shipping_pct"),
        )
        .orderBy(F.desc("total_shipping_cost"))
    )


def payment_methods(fact: DataFrame) -> DataFrame:
    """Orders, revenue and revenue share by payment method."""
    return (
        fact.groupBy("payment_method")
        .agg(
            F.countDistinct("order_id").alias("order_count"),
            F.sum("revenue").alias("total_revenue"),
        )
        .withColumn("pct_of_revenue", percent_of_all("total_revenue"))
        .orderBy(F.desc("total_revenue"))
    )
