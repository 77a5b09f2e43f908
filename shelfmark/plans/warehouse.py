"""From a folder of raw CSV files to a warehouse folder, and back into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import audit
from shelfmark.operators.clean import GAPS
from shelfmark.operators.star import BULK_QUANTITY, HIGH_VALUE, build_fact_sales, calendar
from shelfmark.plans import cleaning
from shelfmark.plans.questions import QUESTIONS, Parameters
from shelfmark.sources import schemas, tables, versions
from shelfmark.sources.shared import settle


def clean_all(
    raw: dict[str, DataFrame], rules: cleaning.Rules = cleaning.ORIGINAL, counted: bool = False
) -> dict[str, DataFrame]:
    """The five cleaned tables and the two id mappings.

    If ``counted``, rows of tables with filled columns carry their NULLs before filling,
    for ``audit.count_filled``.
    """
    regions, region_map = cleaning.clean_regions(raw["regions"], rules.region_names)
    customers, customer_map = cleaning.clean_customers(
        raw["customers"], rules.na_tokens, rules.unknown_loyalty, counted
    )
    products = cleaning.clean_products(raw["products"], rules, counted)
    prices = products.drop(GAPS)
    return {
        "regions": regions,
        "customers": customers,
        "products": products,
        "orders": cleaning.clean_orders(raw["orders"], customer_map, region_map, rules, counted),
        "order_details": cleaning.clean_order_details(raw["order_details"], prices, counted),
        "customer_id_mapping": customer_map,
        "region_id_mapping": region_map,
    }


def build_warehouse(
    spark: SparkSession, raw_folder: str, target: str,
    first_day: date | None = None, last_day: date | None = None,
    rules: cleaning.Rules = cleaning.ORIGINAL,
    high_value: float = HIGH_VALUE, bulk_quantity: int = BULK_QUANTITY,
) -> None:
    """Load, clean and write everything below ``target``, for readers all at once.

    Until the end readers see the tables of the build before, and go on seeing them if
    this one fails. The fact is built from the written tables, whose sizes Spark knows. The
    calendar goes from the first to the last order of the fact, or over the days given.
    Fields of the raw files that do not fit their types are NULL in the tables and rows of
    ``rejects``. ``cleaning_report`` counts rows, filled values and rejects of each table,
    filled values as the cleaned tables are written. ``rules`` are the spellings and
    fillings of the cleaning.
    """
    loaded = {
        name: tables.load_csv(spark, f"{raw_folder}/{name}.csv", ddl)
        for name, ddl in schemas.RAW.items()
    }
    raw = {name: rows for name, (rows, _) in loaded.items()}
    rejects = [
        found.select(F.lit(name).alias("table_name"), "column_name", "value")
        for name, (_, found) in loaded.items()
    ]
    build = versions.Build(spark, target, anew=True)
    build.write("rejects", reduce(DataFrame.unionByName, rejects))
    filled: dict[str, int] = {}
    for name, df in clean_all(raw, rules, counted=True).items():
        df, counts = audit.count_filled(df, cleaning.FILLED.get(name, []))
        build.write(name, df)
        filled[name] = counts.get["filled"]
    clean = {name: build.read(name) for name in schemas.CLEANED}
    told = {name: (raw[name], clean[name], cleaning.FILLED.get(name, [])) for name in raw}
    report = audit.cleaning_report(spark, told, filled, build.read("rejects"))
    build.write("cleaning_report", report)
    fact = build_fact_sales(
        clean["order_details"], clean["orders"], clean["customers"], clean["products"],
        clean["regions"], high_value=high_value, bulk_quantity=bulk_quantity, by_year=True,
    )
    build.write("fact_sales", fact, cut_by="order_year", balanced=True)
    sold = build.read("fact_sales").agg(
        F.coalesce(F.lit(first_day), F.min("order_date")).alias("first_day"),
        F.coalesce(F.lit(last_day), F.max("order_date")).alias("last_day"),
    )
    build.write("dim_date", calendar(sold))
    build.publish()


def add_sales(
    spark: SparkSession, target: str, orders: DataFrame, lines: DataFrame,
    high_value: float = HIGH_VALUE, bulk_quantity: int = BULK_QUANTITY,
) -> versions.Manifest:
    """Add cleaned orders and lines to a warehouse, rewriting only the years they touch.

    An order that is there already is replaced, a line with a known id too; other lines
    join those of their order, of which doubled ones are dropped as in the cleaning. All
    lines of a touched order are built anew, since its shipping is shared among them, and
    leave the year they were in if the order moved. Orders and lines are appended, or
    written anew if touched orders were there. The calendar grows by the days it lacks.
    """
    build = versions.Build(spark, target)
    old = {name: build.read(name) for name in build.tables}
    orders = settle(orders.select(*old["orders"].columns), "sent_orders")
    lines = settle(lines.select(*old["order_details"].columns), "sent_lines")
    touched = settle(
        orders.select("order_id").union(lines.select("order_id")).distinct(), "touched"
    )
    kept_orders = old["orders"].join(orders, "order_id", "left_anti")
    known = old["order_details"].join(touched, "order_id", "left_semi")
    unsent = known.join(lines, "order_detail_id", "left_anti")
    whole = settle(cleaning.drop_duplicate_lines(unsent.unionByName(lines)), "touched_lines")
    if old["orders"].join(touched, "order_id", "left_semi").isEmpty() and known.isEmpty():
        build.append("orders", orders)
        build.append("order_details", whole)
    else:
        build.write("orders", kept_orders.unionByName(orders))
        others = old["order_details"].join(touched, "order_id", "left_anti")
        build.write("order_details", others.unionByName(whole))
    placed = build.read("orders").join(touched, "order_id", "left_semi")
    fresh = settle(
        build_fact_sales(
            whole, placed, old["customers"], old["products"], old["regions"],
            high_value=high_value, bulk_quantity=bulk_quantity,
        ), "fresh_fact",
    )
    sold = old["fact_sales"]
    left = sold.join(touched, "order_id", "left_semi").select("order_year")
    years = [r.order_year for r in left.union(fresh.select("order_year")).distinct().collect()]
    rest = sold.filter(F.col("order_year").isin(years)).join(touched, "order_id", "left_anti")
    build.replace("fact_sales", rest.select(*sold.columns).unionByName(fresh), years)
    days = old["dim_date"].select(F.col("full_date").alias("day"))
    days = days.union(fresh.select("order_date")).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    build.write("dim_date", calendar(days))
    return build.publish()


@dataclass(frozen=True)
class Opened:
    """A written warehouse under the names the business questions use."""

    fact: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    calendar: DataFrame


def ask_all(
    tables_: dict[str, DataFrame], parameters: Parameters = Parameters()
) -> dict[str, DataFrame]:
    """The answers to all business questions over an opened warehouse, by name."""
    opened = Opened(
        fact=tables_["fact_sales"], calendar=tables_["dim_date"],
        **{name: tables_[name] for name in ("customers", "products", "orders")},
    )
    return {name: question(opened, parameters) for name, question in QUESTIONS.items()}


def open_warehouse(
    spark: SparkSession, target: str, names: tuple[str, ...] = tuple(schemas.WAREHOUSE)
) -> dict[str, DataFrame]:
    """The tables of the last whole build by name, read with their fixed schemas."""
    now = versions.current(spark, target)
    if now is None:
        raise FileNotFoundError(f"no build was published in {target}")
    return {name: versions.read(spark, target, name, now.tables[name]) for name in names}
