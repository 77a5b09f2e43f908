"""Customer questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import (
    margin_percent,
    mean,
    percent,
    percent_of_all,
    ratio,
    whole_mean,
)
from shelfmark.operators.ranking import Metric, ntile, ntiles
from shelfmark.sources.shared import settle

# Upper bounds of the discount and churn classes, with their labels.
DISCOUNT_CLASSES = ((0.10, "1-10%"), (0.20, "11-20%"), (0.30, "21-30%"))
NO_DISCOUNT = "No Discount"
CHURN_CLASSES = (
    (30, "Active (0-30 days)"),
    (90, "Recent (30-90 days)"),
    (180, "At Risk (90-180 days)"),
)
CHURNED = "Churned (180+ days)"


def signups_by_month(customers: DataFrame) -> DataFrame:
    """New customers per signup month; an unknown date is a group of its own."""
    return (
        customers.groupBy(
            F.year("signup_date").alias("signup_year"),
            F.month("signup_date").alias("signup_month"),
        )
        .agg(F.countDistinct("customer_id").alias("new_customers"))
        .orderBy("signup_year", "signup_month")
    )


def order_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("customer_id").agg(F.countDistinct("order_id").alias("order_count"))


def orders_per_customer(fact: DataFrame) -> DataFrame:
    return order_counts(fact).orderBy(F.desc("order_count"), "customer_id")


def repeat_rate(fact: DataFrame) -> DataFrame:
    repeat, everyone = F.count_if(F.col("order_count") > 1), F.count("*")
    return order_counts(fact).agg(
        ratio(repeat, everyone).alias("repeat_rate"),
        repeat.alias("repeat_customers"),
        everyone.alias("total_customers"),
    )


def lifetime_value(fact: DataFrame, first: str = "revenue", then: str = "profit") -> DataFrame:
    """Lifetime revenue and profit per customer, by one and then the other."""
    return (
        fact.groupBy("customer_id", "customer_full_name")
        .agg(
            F.sum("revenue").alias("lifetime_revenue"),
            F.sum("profit").alias("lifetime_profit"),
        )
        .orderBy(F.desc(f"lifetime_{first}"), F.desc(f"lifetime_{then}"), "customer_id")
    )


def value_tiles(fact: DataFrame, tiles: int = 5) -> DataFrame:
    """Customers in equal tiles by lifetime revenue; ties by customer id."""
    values = fact.groupBy("customer_id").agg(F.sum("revenue").alias("lifetime_value"))
    order = [F.col("lifetime_value").desc(), F.col("customer_id").asc()]
    return ntile(values, order, tiles, "value_tile")


def value_quintiles(fact: DataFrame, tiles: int = 5) -> DataFrame:
    return (
        value_tiles(fact, tiles)
        .groupBy("value_tile")
        .agg(
            F.count("*").alias("customer_count"),
            mean("lifetime_value").alias("avg_value"),
            F.min("lifetime_value").alias("min_value"),
            F.max("lifetime_value").alias("max_value"),
            F.sum("lifetime_value").alias("tile_revenue"),
        )
        .withColumn("pct_of_revenue", percent_of_all("tile_revenue", digits=None))
        .orderBy("value_tile")
    )


def by_loyalty(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("customer_loyalty_status")
        .agg(mean("revenue").alias("avg_revenue"), mean("profit").alias("avg_profit"))
        .orderBy(F.desc("avg_revenue"))
    )


def _in_country(country: str) -> Column:
    return F.count_if(F.col("country") == country)


def counts_by_country(customers: DataFrame, countries: Sequence[str]) -> DataFrame:
    """One row: all customers, and those of each country in a column."""
    return customers.agg(
        F.count("*").alias("total_customers"),
        *(_in_country(c).alias(f"count_{c.lower()}") for c in countries),
    )


def shares_by_country(customers: DataFrame, countries: Sequence[str]) -> DataFrame:
    return customers.agg(
        *(percent(_in_country(c), F.count("*")).alias(f"pct_{c.lower()}") for c in countries)
    )


def _class_of(value: Column, bounds: Sequence[tuple[float, str]]) -> Column:
    (bound, name), *rest = bounds
    label = F.when(value <= bound, name)
    for bound, name in rest:
        label = label.when(value <= bound, name)
    return label


def discount_effect(
    fact: DataFrame, classes: Sequence[tuple[float, str]] = DISCOUNT_CLASSES
) -> DataFrame:
    """Lines, quantity, revenue and margin by discount class.

    A discount above the last bound has no class; lines of unknown discount are
    left out.
    """
    discount = F.col("discount")
    label = F.when(discount == 0, NO_DISCOUNT).otherwise(_class_of(discount, classes))
    return (
        fact.filter(F.col("is_discounted") | (discount == 0))
        .groupBy(label.alias("discount_range"))
        .agg(
            F.count("*").alias("line_count"),
            mean("quantity").alias("avg_quantity"),
            whole_mean("quantity").alias("whole_quantity"),
            mean("revenue").alias("avg_revenue"),
            margin_percent().alias("profit_margin_pct"),
        )
    )


def churn(
    fact: DataFrame,
    as_of: Column | None = None,
    classes: Sequence[tuple[float, str]] = CHURN_CLASSES,
) -> DataFrame:
    """Customers by days since their last order at ``as_of``.

    Without a date the last order date of the fact is taken. Customers are counted
    per last day first, so that date is found among days, without another scan.
    """
    last = fact.groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
    per_day = last.groupBy("last_order").agg(F.count("*").alias("customers"))
    newest = F.max("last_order").over(Window.partitionBy())  # one row per day
    gap = F.datediff(newest if as_of is None else as_of, "last_order")
    status = _class_of(F.col("gap"), classes).otherwise(CHURNED)
    return (
        per_day.withColumn("gap", gap)
        .groupBy(status.alias("customer_status"))
        .agg(F.sum("customers").alias("customer_count"))
        .withColumn("pct_customers", percent_of_all("customer_count", digits=None))
    )


def rfm(fact: DataFrame, as_of: Column | None = None, tiles: int = 5) -> DataFrame:
    """Recency, frequency and monetary value per customer, each as a tile.

    Tile 1 is best: the latest, most frequent and largest buyers. The customers shuffle
    once, in their aggregate; the tiles come from the values where tiles end.
    """
    buyers = fact.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"),
        F.countDistinct("order_id").alias("frequency"),
        F.sum("revenue").alias("monetary"),
    )
    day = fact.agg(F.max("order_date")).scalar() if as_of is None else as_of
    scored = buyers.withColumn("recency_days", F.datediff(day, "last_order")).drop("last_order")
    metrics = {
        "recency_tile": Metric("recency_days"),
        "frequency_tile": Metric("frequency", largest_first=True),
        "monetary_tile": Metric("monetary", largest_first=True),
    }
    return ntiles(settle(scored, "buyers"), metrics, "customer_id", tiles)


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Customers of each first-order month still ordering some months later."""
    month = (F.year("order_date") * 12 + F.month("order_date") - 1).alias("month_no")
    active = fact.select("customer_id", month).distinct()
    # At most one row per customer and month is left, so a customer's window is
    # bounded by the months of the calendar.
    first = F.min("month_no").over(Window.partitionBy("customer_id"))
    return (
        active.withColumn("first_month", first)
        .groupBy(
            F.floor(F.col("first_month") / 12).cast("int").alias("cohort_year"),
            (F.col("first_month") % 12 + 1).alias("cohort_month"),
            (F.col("month_no") - F.col("first_month")).alias("months_since"),
        )
        .agg(F.count("*").alias("active_customers"))
        .orderBy("cohort_year", "cohort_month", "months_since")
    )
