"""Profiles and audits of raw or loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfmark.functions.measures import margin_percent, mean, percent, whole_mean
from shelfmark.operators.clean import GAPS, gaps
from shelfmark.operators.ranking import exact_percentiles

# What the audits report, and the prices that count as extreme.
NO_CUSTOMER = "Customer does not exist"
NO_REGION = "Region does not exist"
NO_ORDER = "Order does not exist"
NO_PRODUCT = "Product does not exist"
PRICE_BAND = (10, 2000)
PRICE_LABELS = ("Very cheap", "Very expensive", "Normal")


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column: ``column_name``, ``null_count``. One pass over ``df``."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column_name", "null_count")


def orphans(
    child: DataFrame, parent: DataFrame, key: str, issue: str, columns: list[str]
) -> DataFrame:
    """Rows of ``child`` whose ``key`` is not in ``parent``, with the reason."""
    known = parent.select(key)
    return child.join(known, key, "left_anti").select(*columns, F.lit(issue).alias("issue"))


def value_range(df: DataFrame, column: str, earliest: str, latest: str) -> DataFrame:
    return df.agg(F.min(column).alias(earliest), F.max(column).alias(latest))


def _statistics(df: DataFrame, column: str) -> list[Column]:
    whole = isinstance(df.schema[column].dataType, IntegralType)
    return [
        F.count("*").alias("row_count"),
        F.count(column).alias("value_count"),
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
        mean(column).alias("average"),
        *([whole_mean(column).alias("whole_average")] if whole else []),
        F.stddev_samp(F.col(column).cast("double")).alias("deviation"),
    ]


def profile(df: DataFrame, column: str) -> DataFrame:
    """Counts, minimum, maximum, average and sample deviation of the values.

    Whole numbers also get the average without its fraction.
    """
    return df.agg(*_statistics(df, column))


def profile_with_percentiles(
    df: DataFrame, column: str, percentiles: dict[str, float], few_values: bool = False
) -> DataFrame:
    """:func:`profile` plus continuous percentiles under the given names.

    ``few_values`` says that the column's type or meaning bounds its distinct
    values (an age, a two-digit discount): Spark's own ``percentile`` then keeps
    a small table of counts. Other columns go through the distributed ranking.
    """
    if few_values:
        ranks = (F.percentile(F.col(column), F.lit(p)).alias(n) for n, p in percentiles.items())
        return df.agg(*_statistics(df, column), *ranks)
    placed = exact_percentiles(df, column, percentiles).select(F.struct("*")).scalar()
    return profile(df, column).withColumn("placed", placed).select("*", "placed.*").drop("placed")


def by_extreme(df: DataFrame, column: str, key: str, columns: list[str]) -> DataFrame:
    """Rows with a value, largest first; equal values by ``key``."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(*columns)
        .orderBy(F.col(column).desc(), F.col(key).asc())
    )


def count_present(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).agg(F.count("*").alias("total_rows"))


def sign_split(df: DataFrame, column: str) -> DataFrame:
    """How many values are below and above zero; zero itself is in neither."""
    value = F.col(column)
    rows, below, above = F.count(value), F.count_if(value < 0), F.count_if(value > 0)
    return df.agg(
        rows.alias("value_count"),
        below.alias("negative_count"),
        above.alias("positive_count"),
        percent(below, rows, 1).alias("negative_pct"),
        percent(above, rows, 1).alias("positive_pct"),
    )


def outside_band(
    df: DataFrame,
    column: str,
    key: str,
    band: tuple[float, float] = PRICE_BAND,
    labels: tuple[str, str, str] = PRICE_LABELS,
) -> DataFrame:
    """Rows below or above the band, labelled (below, above, in between).

    In order of the value; ``key`` lets many equal values be sorted in parts.
    """
    value = F.col(column)
    low, high = band
    below, above, between = labels
    label = F.when(value < low, below).when(value > high, above).otherwise(between)
    return df.filter((value < low) | (value > high)).withColumn("band", label).orderBy(column, key)


def value_counts(df: DataFrame, column: str, name: str = "row_count") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def value_counts_around(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts of each value before and after a mapping; 0 where it is absent."""
    sides = before.select(column, F.lit(True).alias("is_before")).union(
        after.select(column, F.lit(False))
    )
    return sides.groupBy(column).agg(
        F.count_if("is_before").alias("rows_before"),
        F.count_if(~F.col("is_before")).alias("rows_after"),
    )


def duplicate_census(df: DataFrame, key: str) -> DataFrame:
    """Rows that share a non-NULL ``key``, and how many keys are shared."""
    shared = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("members"))
        .filter("members > 1")
    )
    return shared.agg(
        F.coalesce(F.sum("members"), F.lit(0)).alias("duplicate_rows"),
        F.count("*").alias("shared_keys"),
    )


def load_check(fact: DataFrame) -> DataFrame:
    """Rows, date range, totals and overall margin of the loaded fact."""
    return fact.agg(
        F.count("*").alias("total_rows"),
        F.min("order_date").alias("earliest_date"),
        F.max("order_date").alias("latest_date"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        margin_percent().alias("overall_margin_pct"),
    )


def count_filled(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` without its mark of gaps, and the values filled, known once it is written.

    ``mark_gaps`` marked its rows when no more were to go, so NULLs of removed rows do
    not count. The count is taken by the tasks that write, each of which counts once
    however often it is tried.
    """
    counts = Observation()
    marks = F.col(GAPS) if GAPS in df.columns else gaps(columns)
    filled = F.coalesce(F.sum(marks - gaps(columns)), F.lit(0)).cast("bigint")
    return df.observe(counts, filled.alias("filled")).drop(GAPS), counts


def cleaning_report(
    spark: SparkSession,
    tables: dict[str, tuple[DataFrame, DataFrame, list[str]]],
    filled: dict[str, int],
    rejects: DataFrame | None = None,
) -> DataFrame:
    """Rows before, after and removed, values filled and rejected, per cleaned table.

    ``tables`` maps a name to (raw, cleaned, columns that cleaning fills); NULLs of those
    are given before and after, removed rows included. ``filled`` is what ``count_filled``
    counted as the tables were written. ``rejects`` has a row, with its table_name, for
    each field that did not fit its type.
    """

    def nulls(df: DataFrame, columns: list[str]) -> Column:
        counts = (F.count_if(F.col(c).isNull()) for c in columns)
        return reduce(lambda a, b: a + b, counts, F.lit(0))

    def unfit(name: str) -> Column:
        if rejects is None:
            return F.lit(0).cast("bigint")
        return rejects.filter(F.col("table_name") == name).agg(F.count("*")).scalar()

    def one(name: str, raw: DataFrame, clean: DataFrame, columns: list[str]) -> DataFrame:
        sides = [
            df.agg(F.count("*").alias("n"), nulls(df, columns).cast("bigint").alias("gaps"))
            for df in (raw, clean)
        ]
        before, after = (side.select(F.struct("n", "gaps")).scalar() for side in sides)
        return (
            spark.range(1)
            .select(before.alias("before"), after.alias("after"))
            .select(
                F.lit(name).alias("table_name"),
                F.col("before.n").alias("rows_before"),
                F.col("after.n").alias("rows_after"),
                (F.col("before.n") - F.col("after.n")).alias("rows_removed"),
                F.col("before.gaps").alias("nulls_before"),
                F.col("after.gaps").alias("nulls_after"),
                F.lit(filled[name]).cast("bigint").alias("filled"),
                unfit(name).alias("rejected"),
            )
        )

    return reduce(DataFrame.unionByName, (one(n, *parts) for n, parts in tables.items()))


def row_count(df: DataFrame, name: str = "total_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))
