"""Aggregate measures: exact sums first, one division, rounding last.

Sums run over Decimal or integer columns, so they do not depend on the order in
which partial results meet. Only the two finished sums are turned into doubles.
A zero divisor gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def total(column: str | Column) -> Column:
    return F.sum(column).cast("double")


def mean(column: str | Column) -> Column:
    """Average as exact sum over count; NULL when nothing was counted."""
    return F.try_divide(total(column), F.count(column).cast("double"))


def whole_mean(column: str | Column) -> Column:
    """Average of whole numbers without its fraction, as an integer AVG gives it."""
    counted = F.nullif(F.count(column), F.lit(0))
    return F.call_function("div", F.sum(column), counted)


def mean_over(column: str, frame: WindowSpec) -> Column:
    """:func:`mean` over a window frame."""
    return F.try_divide(
        F.sum(column).over(frame).cast("double"), F.count(column).over(frame).cast("double")
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """100 * part / whole, rounded half up unless ``digits`` is None."""
    share = F.try_divide(100.0 * part.cast("double"), whole.cast("double"))
    return share if digits is None else F.round(share, digits)


def percent_of_all(column: str, digits: int | None = 2) -> Column:
    """A group's part of the sum over all groups, in percent.

    The window has no partition: use it on a frame that is already reduced to one
    row per group, where it saves a second pass over the fact.
    """
    everything = F.sum(column).over(Window.partitionBy())
    return percent(F.col(column), everything, digits)


def margin_percent(digits: int = 2) -> Column:
    """Profit as a percentage of revenue, over the group's sums."""
    return percent(F.sum("profit"), F.sum("revenue"), digits)


def growth_percent(now: Column, before: Column, digits: int | None = 2) -> Column:
    """Change since ``before`` in percent; NULL when there is nothing before."""
    return percent(now.cast("double") - before.cast("double"), before, digits)
