"""Positions in a total order, without putting all rows in one task.

A window without ``partitionBy`` would move the whole table to a single task.
Here the rows are range-partitioned into slices, the slices are written once so
that their numbers cannot change, each slice is ranked by itself, and the sizes
of the earlier slices, one row per slice, are added.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.shared import settle

_SLICE, _WEIGHT, _PLACE = "slice_no", "slice_weight", "slice_place"

#: Bits of ``monotonically_increasing_id`` below the partition's number.
PLACE_BITS = 33


def offsets(slices: DataFrame, size: Column, whole: str) -> DataFrame:
    """Each slice's ``offset``, the sizes of those before it, and the size of all.

    One row per slice, so the unpartitioned windows here and the broadcast of the result
    are bounded by the number of shuffle partitions.
    """
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = slices.groupBy(_SLICE).agg(size.alias("size"))
    return sizes.select(
        _SLICE,
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
        F.sum("size").over(Window.partitionBy()).alias(whole),
    )


def running_total(
    df: DataFrame, order: list[Column], weight: Column, before: str, whole: str
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows and over all rows.

    ``order`` must be a total order. Its last key should be unique, so that
    equal leading values are cut into slices too.
    """
    sliced = settle(
        df.withColumn(_WEIGHT, weight.cast("bigint"))
        .repartitionByRange(*order)
        .withColumn(_SLICE, F.spark_partition_id()),
        "slices",
    )
    sizes = offsets(sliced, F.sum(_WEIGHT), whole)
    inside = (
        Window.partitionBy(_SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        sliced.withColumn("inside", F.sum(_WEIGHT).over(inside) - F.col(_WEIGHT))
        .join(F.broadcast(sizes), _SLICE)
        .withColumn(before, F.col("offset") + F.col("inside"))
        .drop(_SLICE, _WEIGHT, "inside", "offset")
    )


def row_numbers(df: DataFrame, order: list[Column], name: str, whole: str) -> DataFrame:
    """Add the 1-based position of each row and the number of rows.

    The slices are sorted as they are written, and the increasing id holds the slice
    above its low 33 bits and the place within the slice in them, so the rows shuffle once.
    Writing the slices runs a job while the DataFrame is being built.
    """
    placed = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_PLACE, F.monotonically_increasing_id()),
        "slices",
    )
    slice_no = F.shiftright(_PLACE, PLACE_BITS)
    placed = placed.withColumn(_SLICE, slice_no)
    inside = F.col(_PLACE) - F.shiftleft(slice_no, PLACE_BITS)
    return (
        placed.join(F.broadcast(offsets(placed, F.count("*"), whole)), _SLICE)
        .withColumn(name, F.col("offset") + inside + 1)
        .drop(_SLICE, _PLACE, "offset")
    )


def tile_of(position: Column, rows: Column, tiles: int) -> Column:
    """The NTILE of a 1-based position: the first ``rows % tiles`` tiles get one more."""
    small = F.floor(rows / tiles)
    extra = rows % tiles
    in_large = extra * (small + 1)
    large_tile = F.ceil(position / (small + 1))
    small_tile = extra + F.ceil(F.try_divide(position - in_large, small))
    return F.when(position <= in_large, large_tile).otherwise(small_tile).cast("int")


def ntile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    """Add the tile number of each row, as NTILE over the whole table gives it."""
    numbered = row_numbers(df, order, "position", "all_rows")
    tile = tile_of(F.col("position"), F.col("all_rows"), tiles)
    return numbered.withColumn(name, tile).drop("position", "all_rows")


class Metric(NamedTuple):
    """A column that is cut into tiles, and whether its largest values come first."""

    column: str
    largest_first: bool = False

    def order(self) -> Column:
        column = F.col(self.column)
        return column.desc() if self.largest_first else column.asc()

    def after(self, value: object) -> Column:
        """Whether a row's value comes after ``value``; NULL comes before all, or after all."""
        column = F.col(self.column)
        if self.largest_first:
            return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
        later = column.isNotNull() if value is None else column > F.lit(value)
        return F.coalesce(later, F.lit(False))


def last_position(tile: int, rows: Column, tiles: int) -> Column:
    """The last position of a tile, as NTILE deals them."""
    return tile * F.floor(rows / tiles) + F.least(rows % tiles, F.lit(tile))


def tile_ends(df: DataFrame, metric: Metric, key: str, tiles: int) -> list[tuple[object, object]]:
    """Value and key of the last row of each tile but the last, by the metric, then the key.

    Equal values are counted before they are put in order, and only rows of the values
    where tiles end are put in order by key, so no whole row shuffles. One row for each
    tile comes to the driver.
    """
    column = metric.column
    counted = df.groupBy(column).agg(F.count("*").alias("copies"))
    placed = running_total(counted, [metric.order()], F.col("copies"), "before", "all_rows")
    ends = F.array(*(last_position(t, F.col("all_rows"), tiles) for t in range(1, tiles)))
    bounds = (
        placed.withColumn("end", F.explode(F.array_distinct(ends)))
        .filter("before < end and end <= before + copies")
        .orderBy("end")
        .select(column, "before", "copies", "end")
        .collect()
    )
    earlier: dict[object, int] = {}
    rows_before = 0
    for row in bounds:
        if row[0] not in earlier:
            earlier[row[0]] = rows_before
            rows_before += row.copies
    wanted = [earlier[row[0]] + row.end - row.before for row in bounds]
    if not wanted:
        return []
    held = [F.col(column).eqNullSafe(F.lit(value)) for value in earlier]
    at_ends = df.filter(reduce(lambda a, b: a | b, held)).select(column, key)
    numbered = row_numbers(at_ends, [metric.order(), F.col(key).asc()], "position", "all_rows")
    found = numbered.filter(F.col("position").isin(wanted)).orderBy("position").collect()
    return [(row[column], row[key]) for row in found]


def ntiles(df: DataFrame, metrics: dict[str, Metric], key: str, tiles: int) -> DataFrame:
    """Add NTILE over the whole table by each metric, ties by ``key``, under the given names.

    A row's tile is the number of tile ends that it comes after, so the rows stay where
    they are. ``df`` is read several times and should be settled; ``key`` is unique and
    not NULL. Jobs run while the DataFrame is being built.
    """

    def tile(metric: Metric) -> Column:
        found = F.lit(1)
        for value, last_key in tile_ends(df, metric, key, tiles):
            tied = F.col(metric.column).eqNullSafe(F.lit(value)) & (F.col(key) > F.lit(last_key))
            found = found + (metric.after(value) | tied).cast("int")
        return found.cast("int")

    return df.withColumns({name: tile(metric) for name, metric in metrics.items()})


def exact_percentiles(df: DataFrame, column: str, percentiles: dict[str, float]) -> DataFrame:
    """Continuous percentiles of the non-NULL values, in one row.

    Equal values are counted first, with partial counts before the shuffle, so
    one value held by a third of the rows is one row here.
    """
    counted = (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("copies"))
    )
    placed = running_total(counted, [F.col(column).asc()], F.col("copies"), "before", "all_rows")
    value = F.col(column).cast("double")

    def value_at(place: Column) -> Column:
        here = (F.col("before") <= place) & (place < F.col("before") + F.col("copies"))
        return F.max(F.when(here, value))

    def percentile(p: float) -> Column:
        place = F.lit(p) * (F.col("all_rows") - 1)
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return placed.agg(*(percentile(p).alias(name) for name, p in percentiles.items()))
