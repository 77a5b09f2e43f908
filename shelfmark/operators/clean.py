"""Cleaning and conforming operators, generic in table and column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import (
    EMAIL_HOSTS,
    plain_address,
    title_case,
    usable_address,
    with_at_sign,
)
from shelfmark.sources.shared import settle


#: The column that ``mark_gaps`` adds.
GAPS = "gaps_before_filling"


def mark_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add how many of ``columns`` are NULL in a row, before they are filled."""
    return df.withColumn(GAPS, gaps(columns))


def gaps(columns: list[str]) -> Column:
    """The number of NULLs among some columns of a row."""
    return reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def conform(df: DataFrame, column: str, variants: dict[str, str]) -> DataFrame:
    """Replace known spellings of a category; other values pass through."""
    return df.replace(variants, subset=[column])


def to_title_case(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: title_case(F.col(c)) for c in columns})


def repair_emails(
    df: DataFrame,
    column: str = "email",
    original: str = "email_original",
    hosts: tuple[str, ...] = EMAIL_HOSTS,
) -> DataFrame:
    """Repair addresses, keep what was there in ``original``; NULL if beyond repair.

    An address is stripped and lower-cased, gets a missing "@" back before a
    known host, and must then have a dot in its host. The steps are columns of
    their own, so that each is computed once.
    """
    address = F.col(column)
    return (
        df.withColumns({original: address, column: plain_address(address)})
        .withColumn(column, with_at_sign(address, hosts))
        .withColumn(column, usable_address(address))
    )


def flag_missing(df: DataFrame, column: str, flag: str) -> DataFrame:
    return df.withColumn(flag, F.col(column).isNull())


def fill_constants(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def fill_from(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fill NULLs of ``column`` with an expression over the same row."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def fill_group_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """Fill NULLs with the exact median of the row's group, as a double.

    Meant for columns with few distinct values, such as ages or days: the
    aggregate holds one count per distinct value and combines before the
    shuffle, so a large group is never gathered. The medians are written once,
    one row per group, which gives the join their true size. A group without
    any value stays NULL; a row without a group keeps what it has.
    """
    medians = settle(
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.median(column).alias("group_median"))
        .filter("group_median is not null"),
        "medians",
    )
    filled = F.coalesce(F.col(column).cast("double"), F.col("group_median"))
    return df.join(medians, group, "left").withColumn(column, filled).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must settle ties.

    Spark cuts each key to one row before the shuffle (WindowGroupLimit), so many
    copies of one row do not meet in one task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter("place = 1").drop("place")


def merge_duplicates(
    df: DataFrame, keys: list[str], id_column: str, order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Merge rows that share all ``keys`` into the first by ``order``, then id.

    Returns the surviving rows and the mapping (old id, new id) of the others.
    Rows with a NULL key never merge. The first row of a key is an aggregate,
    with partial results before the shuffle, and only keys with several rows
    reach the join. A row with a NULL key joins on its own id instead, so such
    rows spread over all tasks. The joined rows are written once; survivors and
    mapping are filters over them.
    """
    whole_key = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    first = F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), id_column))
    primaries = settle(
        df.filter(whole_key)
        .groupBy(*keys)
        .agg(first.alias("first"), F.count("*").alias("members"))
        .filter("members > 1")
        .select(*keys, F.col(f"first.{id_column}").alias("primary_id"), F.lit(0).alias("spread")),
        "primaries",
    )
    spread = F.when(whole_key, F.lit(0)).otherwise(F.hash(id_column).bitwiseOR(F.lit(1)))
    joined = df.withColumn("spread", spread).join(primaries, [*keys, "spread"], "left")
    matched = settle(joined.select(*df.columns, "primary_id"), "matched")
    is_other = F.col("primary_id") != F.col(id_column)
    survivors = matched.filter(~F.coalesce(is_other, F.lit(False))).select(*df.columns)
    mapping = matched.filter(is_other).select(
        F.col(id_column).alias(f"old_{id_column}"), F.col("primary_id").alias(f"new_{id_column}")
    )
    return survivors, mapping


def repoint(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace merged-away ids in ``column``; ids without a mapping stay."""
    old, new = f"old_{column}", f"new_{column}"
    moved = df.join(mapping, F.col(column) == F.col(old), "left")
    return moved.withColumn(column, F.coalesce(F.col(new), F.col(column))).drop(old, new)


class Cycle(ValueError):
    """Ids that are mapped to each other in a circle, so that none is the last."""


def follow(mapping: DataFrame, old: str, new: str) -> DataFrame:
    """The mapping with every old id sent to the last id of its chain.

    Chains arise where a mapping of one build meets those of later ones. Each round sends
    an id to where its next one points, so a chain of n steps takes log2(n) rounds, each a
    join of the mapping with itself, written once. An id that maps to itself is dropped; one
    with two new ids, or a circle, is an error.
    """
    found = settle(mapping.filter(F.col(old) != F.col(new)).select(old, new).distinct(), "mapping")
    twice = found.groupBy(old).count().filter("count > 1").select(old).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} is mapped to more than one id")
    size, steps = found.count(), 1
    while True:
        ahead = found.select(F.col(old).alias("via"), F.col(new).alias("next"))
        joined = found.join(ahead, F.col(new) == F.col("via"), "left")
        moved = settle(
            joined.select(old, F.coalesce("next", new).alias(new), F.col("via").isNotNull().alias("on")),
            "mapping",
        )
        on = moved.filter("on").select(old).limit(1).collect()
        if not on:
            return moved.select(old, new)
        steps *= 2
        if steps > 2 * size:
            raise Cycle(f"the chain of {on[0][0]} has no end")
        found = moved.select(old, new)


def fill_line_profit(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Recompute a missing profit from the product's prices.

    Known profits are untouched, and a line of an unknown product stays NULL.
    The money is exact: prices are taken as decimals.
    """
    prices = products.select(
        "product_id",
        F.col("unit_price").cast("decimal(12,4)").alias("list_price"),
        F.col("cost_price").cast("decimal(12,4)").alias("list_cost"),
    )
    units = F.col("quantity").cast("decimal(10,0)")
    paid = F.lit(1).cast("decimal(5,2)") - F.col("discount").cast("decimal(5,2)")
    computed = F.col("list_price") * units * paid - F.col("list_cost") * units
    return (
        lines.join(prices, "product_id", "left")
        .withColumn("profit", F.coalesce("profit", F.round(computed, 2).cast("decimal(10,2)")))
        .select(*lines.columns)
    )


def flag_losses(df: DataFrame, column: str = "profit", flag: str = "is_loss_sale") -> DataFrame:
    return df.withColumn(flag, F.coalesce(F.col(column) < 0, F.lit(False)))
