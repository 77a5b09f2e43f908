"""Time series questions.

The fact is reduced to years, quarters or months first; the windows
below see one row per period, never lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import growth_percent, mean_over

MONTH = ("order_year", "order_month")
QUARTER = ("order_year", "order_quarter")

# Quarters that the sales data covers only in part.
PARTIAL_QUARTERS = ((2022, 4), (2025, 4))


def moving_average(fact: DataFrame, months: int = 3) -> DataFrame:
    """Monthly revenue and its mean over this and the preceding months with sales."""
    monthly = fact.groupBy(*MONTH, "order_month_name").agg(
        F.sum("revenue").alias("monthly_revenue")
    )
    frame = Window.orderBy(*MONTH).rowsBetween(1 - months, 0)
    return monthly.withColumn("moving_avg", mean_over("monthly_revenue", frame)).orderBy(*MONTH)


def complete_quarters(
    fact: DataFrame, partial: Sequence[tuple[int, int]] = PARTIAL_QUARTERS
) -> DataFrame:
    """Revenue of the quarters that are not listed as partial, with their months."""
    listed = [
        (F.col("order_year") == year) & (F.col("order_quarter") == quarter)
        for year, quarter in partial
    ]
    kept = fact.filter(~reduce(lambda a, b: a | b, listed)) if listed else fact
    return (
        kept.groupBy(*QUARTER)
        .agg(
            F.sum("revenue").alias("quarterly_revenue"),
            F.countDistinct("order_month").alias("months_in_quarter"),
        )
        .orderBy(*QUARTER)
    )


def same_month_last_year(fact: DataFrame, calendar: DataFrame) -> DataFrame:
    """Monthly revenue beside the same month of the previous year with sales.

    Days, not lines, are joined with the calendar.
    """
    daily = fact.groupBy("order_date").agg(F.sum("revenue").alias("revenue"))
    monthly = (
        daily.join(calendar, daily.order_date == calendar.full_date)
        .groupBy("year", "month", "month_name")
        .agg(F.sum("revenue").alias("revenue"))
    )
    previous = F.lag("revenue").over(Window.partitionBy("month").orderBy("year"))
    return monthly.withColumn("same_month_last_year", previous).orderBy("month", "year")


def period_growth(fact: DataFrame, period: tuple[str, str], digits: int | None) -> DataFrame:
    """Growth of each period against the previous period with sales."""
    summed = fact.groupBy(*period).agg(F.sum("revenue").alias("revenue"))
    previous = F.lag("revenue").over(Window.orderBy(*period))
    return summed.withColumn("previous_revenue", previous).withColumn(
        "growth_pct", growth_percent(F.col("revenue"), F.col("previous_revenue"), digits)
    )


def average_monthly_growth(fact: DataFrame) -> DataFrame:
    growth = period_growth(fact, MONTH, None)
    return growth.agg(F.avg("growth_pct").alias("avg_monthly_growth_pct"))


def average_quarterly_growth(fact: DataFrame) -> DataFrame:
    """Each quarter's growth is rounded before the average is taken."""
    growth = period_growth(fact, QUARTER, 2)
    return growth.agg(F.avg("growth_pct").alias("avg_quarterly_growth_pct"))
