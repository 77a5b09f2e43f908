"""Date parts with the calendar conventions of the sales warehouse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


def week_of_year(day: Column) -> Column:
    """Week number where week 1 holds 1 January and weeks start on Sunday.

    ``weekofyear`` is the ISO week and gives 53 for 2021-01-01; this gives 1.
    """
    lead_in = F.dayofweek(F.trunc(day, "year")) - 1
    return (F.floor((F.dayofyear(day) - 1 + lead_in) / 7) + 1).cast("int")


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)
