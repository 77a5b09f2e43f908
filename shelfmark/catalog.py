"""Every question and operator, by name, over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from shelfmark.operators import audit, clean, distinct, ranking, sketches, star
from shelfmark.plans import cleaning, questions, revenue, warehouse
from shelfmark.sources import buckets, schemas, tables, versions
from shelfmark.sources.shared import new_table_path, settle, stamp
from shelfmark.sources.shop import RawShop, Shop

# Parameters of the questions for these tables; the functions' own defaults fit
# the original retail data.
PARAMETERS = questions.Parameters(
    countries=tuple(f"NATION_{i}" for i in range(25)),
    discount_classes=((0.03, "1-3%"), (0.07, "4-7%"), (0.10, "8-10%")),
    delivery_limits={"Overnight": 500, "Express": 1000, "Standard": 1500, "Economy": 2000},
    partial_quarters=((2001, 3),),
    product=137,
    as_of=None,
)
REGION_SPELLINGS = {
    "africa": "AFRICA",
    "america": "AMERICA",
    "asia": "ASIA",
    "europe": "EUROPE",
    "middle east": "MIDDLE EAST",
}
PRICE_BAND = (1300, 1400)
LINE = ["order_detail_id", "order_id", "product_id"]


class Cleaned:
    """The raw tables of a directory after cleaning, and the star built on them.

    Every cleaned table and mapping is written once, for all that read it.
    """

    def __init__(self, raw: RawShop):
        self.raw = raw
        #: Values filled in each table that was written.
        self.filled: dict[str, int] = {"regions": 0}

    def _write(self, df: DataFrame, table: str) -> DataFrame:
        df, counts = audit.count_filled(df, cleaning.FILLED[table])
        written = settle(df, f"clean_{table}")
        self.filled[table] = counts.get["filled"]
        return written

    @cached_property
    def _regions(self) -> tuple[DataFrame, DataFrame]:
        return cleaning.clean_regions(self.raw.regions, REGION_SPELLINGS)

    @cached_property
    def _customers(self) -> tuple[DataFrame, DataFrame]:
        return cleaning.clean_customers(self.raw.customers, counted=True)

    @cached_property
    def regions(self) -> DataFrame:
        return settle(self._regions[0], "clean_regions")

    @cached_property
    def customers(self) -> DataFrame:
        return self._write(self._customers[0], "customers")

    @cached_property
    def region_mapping(self) -> DataFrame:
        return settle(self._regions[1], "region_mapping")

    @cached_property
    def customer_mapping(self) -> DataFrame:
        return settle(self._customers[1], "customer_mapping")

    @cached_property
    def raw_orders(self) -> DataFrame:
        """Written once too: cleaning and its audits pass over them several times."""
        return settle(self.raw.orders, "raw_orders")

    @cached_property
    def repointed(self) -> DataFrame:
        return cleaning.repoint_orders(
            self.raw_orders, self.customer_mapping, self.region_mapping
        )

    @cached_property
    def orders(self) -> DataFrame:
        orders = cleaning.clean_orders(
            self.raw_orders, self.customer_mapping, self.region_mapping, counted=True
        )
        return self._write(orders, "orders")

    @cached_property
    def products(self) -> DataFrame:
        return self._write(cleaning.clean_products(self.raw.products, counted=True), "products")

    @cached_property
    def order_details(self) -> DataFrame:
        lines = cleaning.clean_order_details(self.raw.order_details, self.products, counted=True)
        return self._write(lines, "order_details")

    @cached_property
    def fact(self) -> DataFrame:
        return star.build_fact_sales(
            self.order_details, self.orders, self.customers, self.products, self.regions
        )


class ShopWarehouse:
    """The shop's tables under the names the business questions use."""

    def __init__(self, shop: Shop):
        self.shop = shop

    @property
    def fact(self) -> DataFrame:
        return self.shop.fact

    @property
    def customers(self) -> DataFrame:
        return self.shop.customers

    @property
    def products(self) -> DataFrame:
        return self.shop.products

    @property
    def orders(self) -> DataFrame:
        return self.shop.placed_orders

    @property
    def calendar(self) -> DataFrame:
        return star.calendar_of(self.shop.fact)


class Tables:
    """One directory as clean shop, raw shop and cleaned tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.shop = Shop(spark, folder)
        self.warehouse = ShopWarehouse(self.shop)
        self.raw = RawShop(spark, folder)
        self.cleaned = Cleaned(self.raw)

    def written(
        self, df: DataFrame, name: str, schema: str, csv: bool, kinds: bool = True
    ) -> DataFrame:
        """``df`` after a round trip through a file of the given schema.

        Without ``kinds`` it is written in its own types and order of columns.
        """
        path = new_table_path(self.spark, name)
        shaped = df
        if kinds:
            shaped = df.select(*(F.col(f.name).cast(f.dataType) for f in schemas.struct(schema)))
        if csv:
            tables.write_csv(shaped, path)
            return tables.load_csv(self.spark, path, schema)[0]
        tables.write_table(shaped, path)
        return tables.read_parquet(self.spark, path, schema)


    def bucketed(self) -> DataFrame:
        """The fact's revenue with the products' columns, both in buckets of the product."""
        sold = self.shop.fact.select("product_id", "revenue")
        number = buckets.enough_buckets(sold)
        lines = buckets.write_bucketed(sold, "product_id", number, "sold")
        goods = self.shop.products.select("product_id", "category", "supplier")
        dimension = buckets.write_dimension(goods, "product_id", number, "goods")
        return lines.join(self.spark, dimension)

    def with_added_month(self) -> DataFrame:
        """The fact of the cleaned tables, all but the last month built and that added."""
        clean, target = self.cleaned, new_table_path(self.spark, "warehouse")
        orders = clean.orders
        last = orders.agg(F.trunc(F.max("order_date"), "month")).scalar()
        late = orders.filter(F.col("order_date") >= last)
        # with their true size Spark need not shuffle all lines to find those of a month
        late_ids = settle(late.select("order_id"), "late_orders")
        late_lines = clean.order_details.join(late_ids, "order_id", "left_semi")
        build = versions.Build(self.spark, target)
        early = orders.filter(F.col("order_date") < last)
        lines = clean.order_details.join(late_ids, "order_id", "left_anti")
        for name, df in (
            ("orders", early), ("order_details", lines), ("customers", clean.customers),
            ("products", clean.products), ("regions", clean.regions),
        ):
            build.write(name, df)
        fact = star.build_fact_sales(
            *(build.read(n) for n in ("order_details", "orders", "customers", "products", "regions")),
            by_year=True,
        )
        build.write("fact_sales", fact, cut_by="order_year", balanced=True)
        build.write("dim_date", star.calendar_of(build.read("fact_sales")))
        build.publish()
        now = warehouse.add_sales(self.spark, target, late, late_lines)
        return versions.read(self.spark, target, "fact_sales", now.tables["fact_sales"])


Question = Callable[[Tables], DataFrame]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Cut float noise off measures whose last digits depend on summation order."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _gaps(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be NULL, as doubles: every engine's frame holds those alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _quoted(products_: DataFrame) -> DataFrame:
    """Product names with the comma and inner quote that CSV must escape."""
    return products_.withColumn("product_name", F.concat("product_name", F.lit(', 12"')))


SHARES = {"median": 0.5, "p95": 0.95}


def _sketched(products_: DataFrame) -> DataFrame:
    """Whether medians and 95 % points of prices by category, merged from suppliers' sketches,
    lie within twice the error that 99 of 100 sketches keep to."""
    fine = settle(sketches.sketch(products_, "unit_price", "category", "supplier"), "sketches")
    found = settle(sketches.quantiles(sketches.merge(fine, "category"), SHARES), "quantiles")
    off = sketches.off_by(products_, "unit_price", found, "category", SHARES)
    within = {f"{name}_within": F.col(name) <= 2 * sketches.rank_error() for name in SHARES}
    return off.join(found.select("category", "n"), "category").select(
        "category", "n", *(test.alias(name) for name, test in within.items())
    )


def _broken(products_: DataFrame) -> DataFrame:
    """Product names and suppliers with line breaks and quotes."""
    return products_.withColumns({
        "product_name": F.concat("product_name", F.lit('\n\nsecond, "line"\n')),
        "supplier": F.concat(F.lit('"'), "supplier", F.lit("\n,")),
    })


def _known_orders(t: Tables) -> DataFrame:
    return t.raw.placed_orders.join(t.shop.customers, "customer_id", "left_semi")


def _business(name: str) -> Question:
    return lambda t: questions.QUESTIONS[name](t.warehouse, PARAMETERS)


BUSINESS: dict[str, Question] = {
    **{name: _business(name) for name in questions.QUESTIONS},
    "q10_signups_by_month": lambda t: _gaps(
        _business("q10_signups_by_month")(t), "signup_year", "signup_month"
    ),
    "q48_avg_monthly_growth": lambda t: _rounded(
        _business("q48_avg_monthly_growth")(t), "avg_monthly_growth_pct"
    ),
    "q49_avg_quarterly_growth": lambda t: _rounded(
        _business("q49_avg_quarterly_growth")(t), "avg_quarterly_growth_pct"
    ),
}

#: Ordered lists with their positions: the columns that put them in order, "-" for largest first.
RANKED = {
    "q11_orders_per_customer": ("-order_count", "customer_id"),
    "q13_lifetime_revenue": ("-lifetime_revenue", "-lifetime_profit", "customer_id"),
    "q14_lifetime_profit": ("-lifetime_profit", "-lifetime_revenue", "customer_id"),
    "q21_products_by_revenue": ("-total_revenue", "product_id"),
    "q22_products_by_quantity": ("-total_quantity", "product_id"),
    "q23_products_by_profit": ("-total_profit", "product_id"),
    "q32_low_stock": ("-total_revenue", "product_id"),
    "q34_out_of_stock": ("-total_revenue", "product_id"),
    "q37_shipping_share_by_order": ("-shipping_pct", "order_id"),
}


def _ranked(name: str) -> Question:
    """The list with each row's position, as the whole table's order gives it."""

    def ask(t: Tables) -> DataFrame:
        order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in RANKED[name]]
        placed = ranking.row_numbers(BUSINESS[name](t), order, "position", "all_rows")
        return placed.drop("all_rows")

    return ask


SORTED: dict[str, Question] = {f"srt01_{name}": _ranked(name) for name in RANKED}

AUDITS: dict[str, Question] = {
    "aud01_null_counts": lambda t: audit.null_counts(t.raw.customers),
    "aud02_orders_without_customer": lambda t: audit.orphans(
        t.raw.placed_orders, t.shop.customers, "customer_id", audit.NO_CUSTOMER,
        ["order_id", "customer_id", "order_date"],
    ),
    "aud03_orders_without_region": lambda t: audit.orphans(
        t.raw.orders, t.shop.regions, "region_id", audit.NO_REGION,
        ["order_id", "region_id", "order_date"],
    ),
    "aud04_lines_without_order": lambda t: audit.orphans(
        t.raw.unpriced_lines, _known_orders(t), "order_id", audit.NO_ORDER, LINE
    ),
    "aud05_lines_without_product": lambda t: audit.orphans(
        t.raw.unpriced_lines, t.raw.products, "product_id", audit.NO_PRODUCT, LINE
    ),
    "aud06_signup_range": lambda t: audit.value_range(
        t.raw.customers, "signup_date", "earliest_signup", "latest_signup"
    ),
    "aud06_order_range": lambda t: audit.value_range(
        t.raw.placed_orders, "order_date", "earliest_order", "latest_order"
    ),
    "aud07_age_profile": lambda t: _rounded(
        audit.profile_with_percentiles(
            t.raw.customers, "age", {"q1": 0.25, "median": 0.5, "q3": 0.75}, few_values=True
        ),
        "deviation",
    ),
    "aud08_profit_profile": lambda t: _rounded(
        audit.profile(t.raw.order_details, "profit"), "deviation"
    ),
    "aud09_price_profile": lambda t: _rounded(
        audit.profile_with_percentiles(t.raw.products, "unit_price", {"median": 0.5}),
        "deviation", "median",
    ),
    "aud10_discount_profile": lambda t: _rounded(
        audit.profile_with_percentiles(
            t.raw.unpriced_lines, "discount", {"median": 0.5}, few_values=True
        ),
        "deviation",
    ),
    "aud11_customers_by_age": lambda t: audit.by_extreme(
        t.raw.customers, "age", "customer_id",
        ["customer_id", "first_name", "last_name", "country", "age"],
    ),
    "aud12_known_profits": lambda t: audit.count_present(t.raw.order_details, "profit"),
    "aud13_profit_signs": lambda t: audit.sign_split(t.raw.order_details, "profit"),
    "aud14_extreme_prices": lambda t: audit.outside_band(
        t.raw.products.select("product_id", "product_name", "category", "unit_price"),
        "unit_price", "product_id", PRICE_BAND,
    ),
    "aud15_region_ids_around_mapping": lambda t: audit.value_counts_around(
        t.cleaned.raw_orders, t.cleaned.repointed, "region_id"
    ),
    "aud15_ship_modes": lambda t: audit.value_counts(t.raw.placed_orders, "ship_mode"),
    "aud16_shared_emails": lambda t: audit.duplicate_census(
        clean.repair_emails(t.raw.customers), "email"
    ),
    "aud17_load_check": lambda t: audit.load_check(t.shop.fact),
    "aud18_cleaning_report": lambda t: audit.cleaning_report(
        t.spark,
        {
            "regions": (t.raw.regions, t.cleaned.regions, []),
            "customers": (t.raw.customers, t.cleaned.customers, ["loyalty_status", "age"]),
            "products": (t.raw.products, t.cleaned.products, ["cost_price"]),
            "orders": (t.cleaned.raw_orders, t.cleaned.orders, ["delivery_time_days"]),
            "order_details": (
                t.raw.order_details, t.cleaned.order_details, ["discount", "profit"],
            ),
        },
        t.cleaned.filled,
    ),
    "aud19_calendar_days": lambda t: audit.row_count(
        star.calendar_of(t.shop.placed_orders), "total_dates"
    ),
}

CLEANING: dict[str, Question] = {
    "cln01_repaired_emails": lambda t: clean.repair_emails(t.raw.customers).select(
        "customer_id", "email_original", "email"
    ),
    "cln03_customer_survivors": lambda t: t.cleaned.customers.select("customer_id", "email"),
    "cln03_customer_mapping": lambda t: t.cleaned.customer_mapping,
    "cln04_orders_repointed": lambda t: t.cleaned.repointed.select("order_id", "customer_id"),
    "cln05_regions_repointed": lambda t: t.cleaned.repointed.select("order_id", "region_id"),
    "cln06_loyalty_filled": lambda t: t.cleaned.customers.select(
        "customer_id", "loyalty_status"
    ),
    "cln06_discount_filled": lambda t: t.cleaned.order_details.select(*LINE, "discount"),
    "cln07_age_filled": lambda t: t.cleaned.customers.select("customer_id", "country", "age"),
    "cln08_delivery_filled": lambda t: t.cleaned.orders.select(
        "order_id", "ship_mode", "delivery_time_days"
    ),
    "cln09_missing_signups": lambda t: t.cleaned.customers.select(
        "customer_id", "signup_date", "signup_date_missing"
    ),
    "cln10_costs_imputed": lambda t: t.cleaned.products.select(
        "product_id", "unit_price", "cost_price", "cost_price_imputed"
    ),
    "cln11_orders_conformed": lambda t: t.cleaned.orders.select(
        "order_id", "ship_mode", "payment_method", "order_priority"
    ),
    "cln11_stock_status_conformed": lambda t: t.cleaned.products.select(
        "product_id", "stock_status"
    ),
    "cln12_title_case": lambda t: t.cleaned.customers.select("customer_id", "country", "city"),
    "cln12_category_title_case": lambda t: t.cleaned.products.select(
        "product_id", "category", "subcategory"
    ),
    "cln13_regions": lambda t: t.cleaned.regions,
    "cln13_region_mapping": lambda t: t.cleaned.region_mapping,
    "cln14_lines_once": lambda t: cleaning.drop_duplicate_lines(t.raw.order_details),
    "cln15_profit_filled": lambda t: t.cleaned.order_details.select(*LINE, "quantity", "profit"),
    "cln16_loss_flags": lambda t: t.cleaned.order_details.select(*LINE, "is_loss_sale"),
}

CONSTRUCTION: dict[str, Question] = {
    "dim01_calendar": lambda t: star.calendar_of(t.shop.placed_orders),
    "fct01_fact_sales": lambda t: _gaps(t.shop.fact, "delivery_time_days"),
    "fct02_date_parts": lambda t: t.shop.placed_orders.select("order_id", "order_date").withColumns(
        star.order_date_parts()
    ),
    "fct03_shipping_allocation": lambda t: t.shop.fact.groupBy("order_id").agg(
        F.sum("shipping_cost").alias("allocated"), F.sum("revenue").alias("revenue")
    ),
    "fct03_exact_allocation": lambda t: star.allocate_exactly(
        t.shop.fact.drop("shipping_cost").join(
            t.shop.placed_orders.select("order_id", F.col("shipping_cost").alias("order_shipping")),
            "order_id",
        ), "order_shipping", "revenue", "order_id", "order_detail_id", "shipping_cost",
    ).select(*LINE, "revenue", "shipping_cost"),
    "agg03_customers_by_bitmap": lambda t: _gaps(
        distinct.distinct_by_month(t.shop.fact, "customer_id", "customers"),
        "order_year", "order_month",
    ),
    "agg07_price_sketches": lambda t: _sketched(t.raw.products),
    "jon03_bucketed_products": lambda t: t.bucketed().groupBy("category", "supplier").agg(
        F.count("*").alias("lines"), F.sum("revenue").alias("revenue")
    ),
    "cln04_chained_ids": lambda t: clean.follow(
        t.shop.customers.filter("customer_id % 16 <> 0").select(
            F.col("customer_id").alias("old_customer_id"),
            (F.col("customer_id") - 1).alias("new_customer_id"),
        ), "old_customer_id", "new_customer_id",
    ),
    "fct06_flag_counts": lambda t: t.shop.fact.agg(
        *(
            F.count_if(flag).alias(flag)
            for flag in ("is_loss_sale", "is_discounted", "is_high_value", "is_bulk_order")
        )
    ),
    "fct08_country_from_region": lambda t: star.overwrite_from(
        t.shop.fact.select(*LINE, "region_id").withColumn("customer_country", F.lit("unknown")),
        t.cleaned.regions,
        "region_id",
        "customer_country",
        F.col("country"),
    ).withColumnRenamed("customer_country", "region_country"),
    "fct10_full_name": lambda t: star.overwrite_from(
        t.shop.fact.select(*LINE, "customer_id"),
        t.shop.customers,
        "customer_id",
        "customer_full_name",
        star.full_name(),
    ),
    "fct11_added_month": lambda t: t.with_added_month().groupBy("order_id", "order_year").agg(
        F.count("*").alias("lines"),
        F.sum("revenue").alias("revenue"),
        F.sum("shipping_cost").alias("shipping_cost"),
        F.sum("profit").alias("profit"),
    ),
    "fct_from_cleaned": lambda t: revenue.by_year(t.cleaned.fact),
    "fct_from_cleaned_check": lambda t: audit.load_check(t.cleaned.fact),
}

FILES: dict[str, Question] = {
    "src01_csv_scan": lambda t: _gaps(
        t.written(t.raw.orders, "orders_csv", schemas.RAW["orders"], csv=True),
        "delivery_time_days",
    ),
    "src02_quoted_csv": lambda t: t.written(
        _quoted(t.raw.products), "products_csv", schemas.RAW["products"], csv=True
    ),
    "src06_quoted_line_breaks": lambda t: t.written(
        _broken(t.raw.products), "products_csv", schemas.RAW["products"], csv=True
    ),
    "src03_mapping_scan": lambda t: t.written(
        t.cleaned.customer_mapping, "mapping_csv", schemas.CUSTOMER_MAPPING, csv=True
    ),
    "src04_float_written_integers": lambda t: _gaps(
        t.written(
            t.raw.orders.withColumn("delivery_time_days", F.expr("cast(delivery_time_days as double)")),
            "orders_csv", schemas.RAW["orders"], csv=True, kinds=False,
        ), "delivery_time_days",
    ),
    "src05_reordered_header": lambda t: t.written(
        t.cleaned.region_mapping.select("new_region_id", "old_region_id"),
        "mapping_csv", schemas.REGION_MAPPING, csv=True, kinds=False,
    ),
    "snk03_customers_csv": lambda t: _gaps(
        t.written(t.raw.customers, "customers_csv", schemas.RAW["customers"], csv=True), "age"
    ),
    "snk01_cleaned_products": lambda t: t.written(
        t.cleaned.products, "products", schemas.PRODUCTS_CLEANED, csv=False
    ),
    "snk02_region_mapping": lambda t: t.written(
        t.cleaned.region_mapping, "region_mapping", schemas.REGION_MAPPING, csv=False
    ),
}

QUESTIONS = {**BUSINESS, **SORTED, **AUDITS, **CLEANING, **CONSTRUCTION, **FILES}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, as other engines' frames hold them."""
    types = {DecimalType: "double", DateType: "string"}
    return df.select(
        *(
            F.col(f.name).cast(types[type(f.dataType)]) if type(f.dataType) in types else f.name
            for f in df.schema
        )
    )


_open: dict[tuple[str, str], tuple[tuple, Tables]] = {}


def tables_of(spark: SparkSession, folder: str) -> Tables:
    """The tables of a directory, kept for the Spark application while its files stay."""
    key, now = (spark.conf.get("spark.app.id", "app"), folder), stamp(spark, folder)
    if key not in _open or _open[key][0] != now:
        _open[key] = now, Tables(spark, folder)
    return _open[key][1]


def answer(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return comparable(QUESTIONS[name](tables_of(spark, folder)))
