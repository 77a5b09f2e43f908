"""Regional questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import growth_percent, percent_of_all
from shelfmark.plans.revenue import margins

COUNTRY = ("region_id", "region_country")


def _country_revenue(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*COUNTRY).agg(F.sum("revenue").alias("country_revenue"))


def revenue_by_country(fact: DataFrame) -> DataFrame:
    return _country_revenue(fact).orderBy(F.desc("country_revenue"))


def country_shares(fact: DataFrame) -> DataFrame:
    return (
        _country_revenue(fact)
        .withColumn("country_share_pct", percent_of_all("country_revenue"))
        .orderBy("country_share_pct")
    )


def country_growth(fact: DataFrame) -> DataFrame:
    """Growth of each country against its previous year with sales."""
    years = fact.groupBy(*COUNTRY, "order_year").agg(F.sum("revenue").alias("current_revenue"))
    previous = F.lag("current_revenue").over(Window.partitionBy(*COUNTRY).orderBy("order_year"))
    return (
        years.withColumn("previous_revenue", previous)
        .withColumn(
            "growth_pct", growth_percent(F.col("current_revenue"), F.col("previous_revenue"))
        )
        .orderBy(F.desc("order_year"))
    )


def country_margins(fact: DataFrame) -> DataFrame:
    return margins(fact, *COUNTRY, "order_year").orderBy("order_year", F.desc("profit_margin_pct"))


def manager_margins(fact: DataFrame) -> DataFrame:
    return margins(fact, "region_manager", *COUNTRY, "order_year").orderBy(
        "order_year", F.desc("profit_margin_pct")
    )


def revenue_tree(fact: DataFrame) -> DataFrame:
    """Revenue of region, country and category with all subtotals.

    The lines are summed to the leaves first; the rollup, which copies its input
    once per level, then runs over the leaves only.
    """
    levels = ["region_name", "region_country", "product_category"]
    leaves = fact.groupBy(*levels).agg(F.sum("revenue").alias("leaf_revenue"))
    return (
        leaves.rollup(*levels)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("leaf_revenue").alias("total_revenue"),
        )
        .orderBy(*levels)
    )
