"""Exact distinct counts that can be merged: bitmaps over dense numbers.

A COUNT DISTINCT by month cannot be added up to years. A bitmap with one bit for each id
can: the years' bitmaps are the union of their months', and their ones are the count.
Ids are numbered densely first, so bitmaps of ``BITS`` numbers are well filled; a group
has one bitmap row for each stretch of numbers it has ids in, 4 KB each, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import row_numbers
from shelfmark.sources.shared import settle

#: Numbers that a bitmap row of Spark's functions covers.
BITS = 32_768
BUCKET, BITMAP, NUMBER = "bitmap_bucket", "bitmap", "id_number"


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """``column`` and ``id_number``: the distinct ids, numbered from 1 in their order."""
    ids = df.select(column).filter(F.col(column).isNotNull()).distinct()
    numbered = row_numbers(ids, [F.col(column).asc()], NUMBER, "all_rows")
    return settle(numbered.select(column, NUMBER), "numbers")


def bitmaps(df: DataFrame, number: str, *keys: str) -> DataFrame:
    """The numbers that occur with each combination of ``keys``, as bitmap rows.

    Bits are set before the shuffle, so a group of any size moves one row for each task
    and stretch of numbers. NULL is no number.
    """
    bucket = F.bitmap_bucket_number(F.col(number))
    return (
        df.filter(F.col(number).isNotNull())
        .groupBy(*keys, bucket.alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias(BITMAP))
    )


def merge(found: DataFrame, *keys: str) -> DataFrame:
    """Bitmap rows of coarser ``keys``, from those of finer ones alone."""
    return found.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def count(found: DataFrame, name: str, *keys: str) -> DataFrame:
    """The number of distinct numbers of each group of bitmap rows that were merged by ``keys``."""
    return found.groupBy(*keys).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))


def distinct_by_month(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct ids by month, year and in all, the rows read once for all three.

    ``df`` has ``order_year`` and ``order_month``; ``level`` tells which of them a row has.
    """
    numbers = dense_numbers(df, column)
    seen = df.select("order_year", "order_month", column).distinct().join(numbers, column)
    months = settle(bitmaps(seen, NUMBER, "order_year", "order_month"), "bitmaps")
    years = merge(months, "order_year")
    levels = [
        ("month", count(months, name, "order_year", "order_month")),
        ("year", count(years, name, "order_year").withColumn("order_month", F.lit(None).cast("int"))),
        ("all", count(merge(years), name).withColumns(
            {c: F.lit(None).cast("int") for c in ("order_year", "order_month")})),
    ]
    by_name = [
        df_.select(F.lit(level).alias("level"), "order_year", "order_month", name)
        for level, df_ in levels
    ]
    return by_name[0].union(by_name[1]).union(by_name[2])
