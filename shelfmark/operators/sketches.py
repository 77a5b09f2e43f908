"""Quantiles from sketches: one pass, no sort of the values, mergeable by group.

A KLL sketch of parameter k has a few k values, whatever the rows. The rank of the value it
gives for a quantile is off by at most ``rank_error(k)`` of the rows in 99 of 100 sketches;
exact percentiles are in ``ranking``. Sketches of days or shops can be kept and merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values a sketch keeps, roughly; more are more exact.
K = 400


def rank_error(k: int = K) -> float:
    """The normalised rank error that 99 of 100 sketches keep to (single-sided)."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, column: str, *keys: str, k: int = K) -> DataFrame:
    """A ``sketch`` of the non-NULL values of each group, with their number ``n``."""
    value = F.col(column).cast("double")
    return df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count(column).alias("n")
    )


def merge(found: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups from those of finer ones alone."""
    return found.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n")
    )


def quantile(p: float) -> Column:
    """The value at a share ``p`` of a sketch, NULL if it has no values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))


def quantiles(found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Each group's quantiles under the given names, in place of its sketch."""
    named = found.withColumns({name: quantile(p) for name, p in shares.items()})
    return named.drop("sketch")


def off_by(df: DataFrame, column: str, estimates: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """How far the ranks of estimated quantiles are off, by group of ``key``.

    The rank of an estimate lies between the shares of smaller and of not larger values.
    ``estimates`` has one row a group.
    """
    value = F.col(column).cast("double")

    def error(name: str, p: float) -> Column:
        rows = F.count(column).cast("double")
        below = F.count_if(value < F.col(name)) / rows
        upto = F.count_if(value <= F.col(name)) / rows
        return F.greatest(below - p, p - upto, F.lit(0.0)).alias(name)

    joined = df.select(key, column).join(F.broadcast(estimates.select(key, *shares)), key)
    return joined.groupBy(key).agg(*(error(name, p) for name, p in shares.items()))
