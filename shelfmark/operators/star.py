"""The sales fact and the calendar."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import dates
from shelfmark.operators.ranking import row_numbers
from shelfmark.sources.shared import SMALLEST, settle

MONEY = "decimal(10,2)"
MARGIN = "decimal(18,4)"

# Limits of the sales warehouse.
FIRST_DAY = date(2021, 1, 1)
LAST_DAY = date(2025, 12, 31)
HIGH_VALUE = 500
BULK_QUANTITY = 5


def calendar(bounds: DataFrame) -> DataFrame:
    """One row per day, with its 17 attributes.

    ``bounds`` is one row with the columns ``first_day`` and ``last_day``.
    """
    return with_calendar_parts(
        bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("full_date"))
    )


def calendar_of(df: DataFrame, column: str = "order_date") -> DataFrame:
    """The calendar from the first to the last date in ``column``."""
    return calendar(df.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day")))


def with_calendar_parts(days: DataFrame) -> DataFrame:
    day = F.col("full_date")
    year, quarter = F.year(day), F.quarter(day)
    month, weekday = dates.month_name(day), dates.weekday_name(day)
    return days.select(
        dates.date_key(day).alias("date_key"),
        day,
        year.alias("year"),
        year.cast("string").alias("year_name"),
        quarter.alias("quarter"),
        F.concat(F.lit("Q"), quarter.cast("string")).alias("quarter_name"),
        F.month(day).alias("month"),
        month.alias("month_name"),
        F.left(month, F.lit(3)).alias("month_name_short"),
        F.concat(month, F.lit(" "), year.cast("string")).alias("month_year"),
        dates.week_of_year(day).alias("week_of_year"),
        F.day(day).alias("day"),
        F.dayofweek(day).alias("day_of_week"),
        weekday.alias("day_name"),
        F.left(weekday, F.lit(3)).alias("day_name_short"),
        dates.is_weekend(day).alias("is_weekend"),
        (~dates.is_weekend(day)).alias("is_weekday"),
    )


def dim_date(spark: SparkSession, first: date = FIRST_DAY, last: date = LAST_DAY) -> DataFrame:
    days = spark.range(1).select(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"))
    return calendar(days)


def order_date_parts(day: str = "order_date") -> dict[str, Column]:
    d = F.col(day)
    return {
        "order_year": F.year(d),
        "order_quarter": F.quarter(d),
        "order_month": F.month(d),
        "order_month_name": dates.month_name(d),
        "order_day": F.day(d),
        "order_day_name": dates.weekday_name(d),
    }


def order_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.sum("total_price").alias("order_total"))


def allocate(amount: Column, part: Column, whole: Column) -> Column:
    """The share of ``amount`` that ``part`` has in ``whole``."""
    return (amount * F.try_divide(part, whole)).cast(MONEY)


#: Lines of an order up to which one task shares the order's amount among them.
LINES_IN_A_TASK = 100_000


def allocate_exactly(
    lines: DataFrame, amount: str, part: str, order: str, line: str, name: str,
    lines_in_a_task: int = LINES_IN_A_TASK,
) -> DataFrame:
    """Add ``name``: each line's share of its order's amount, adding up to it to the cent.

    A line first gets its share rounded down; the cents left go one each to the lines with
    the largest remainders, equal ones by line id. Shares and remainders are whole numbers.
    Lines of larger orders than a task should hold are put in order by all tasks; both
    ways give the same shares. NULL where the parts of an order do not add up to more than
    nothing, or the amount is unknown. A NULL part gets nothing.
    """
    cents = {c: (F.col(c) * 100).cast("decimal(18,0)") for c in (amount, part)}
    whole, product = F.col("whole_cents"), (cents[amount] * F.coalesce(cents[part], F.lit(0)))
    sized = settle(
        lines.groupBy(order).agg(
            F.sum(cents[part]).cast("decimal(18,0)").alias("whole_cents"),
            F.count("*").alias("order_lines"),
        ), "order_sizes",
    )
    rest = F.when(whole > 0, F.pmod(product, whole.cast("decimal(38,0)")).cast("decimal(18,0)"))
    base = lines.join(sized, order).withColumn("rest", rest).withColumn(
        "low", F.when(whole > 0, ((product - F.col("rest")) / whole).cast("decimal(18,0)"))
    )
    by = [F.col("rest").desc(), F.col(line).asc(), F.col(part).desc()]
    is_large = F.col("order_lines") > lines_in_a_task
    # one window, and so one sort, for both
    window = Window.partitionBy(order).orderBy(*by)
    whole_order = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = base.filter(~is_large).withColumns({
        "place": F.row_number().over(window).cast("bigint"),
        "given": F.sum("low").over(whole_order),
    })
    if not sized.filter(is_large).isEmpty():
        large = row_numbers(
            base.filter(is_large), [F.col(order).asc(), *by], "place", "all_rows"
        ).drop("all_rows")
        large = settle(large, "large_orders")
        first = large.groupBy(order).agg(
            F.min("place").alias("first_place"), F.sum("low").alias("given")
        )
        # a row for each order of more than ``lines_in_a_task`` lines
        large = large.join(first, order).withColumn("place", F.col("place") - F.col("first_place") + 1)
        placed = placed.unionByName(large.drop("first_place"))
    left = cents[amount] - F.col("given")
    share = (F.col("low") + (F.col("place") <= left).cast("int")) / 100
    return placed.withColumn(name, share.cast(MONEY)).select(*lines.columns, name)


def line_measures() -> dict[str, Column]:
    quantity = F.col("quantity").cast("decimal(10,0)")
    gross = F.col("unit_price") * quantity
    return {
        "cost": (F.col("cost_price") * quantity).cast(MONEY),
        "gross_amount": gross.cast(MONEY),
        "discount_amount": (gross * F.col("discount")).cast(MONEY),
    }


def guarded_margin() -> Column:
    """Profit over revenue; NULL unless there is revenue."""
    margin = F.try_divide(F.col("profit"), F.col("revenue"))
    return F.when(F.col("revenue") > 0, margin).cast(MARGIN)


def line_flags(high_value: float = HIGH_VALUE, bulk: int = BULK_QUANTITY) -> dict[str, Column]:
    """Yes/no flags; an unknown value counts as no."""
    tests = {
        "is_loss_sale": F.col("profit") < 0,
        "is_discounted": F.col("discount") > 0,
        "is_high_value": F.col("revenue") > high_value,
        "is_bulk_order": F.col("quantity") > bulk,
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def full_name() -> Column:
    """First and last name; NULL when either is."""
    return F.concat("first_name", F.lit(" "), "last_name")


def order_side(orders: DataFrame, customers: DataFrame, regions: DataFrame) -> DataFrame:
    """Orders (with ``order_total``) and all customer and region attributes.

    The dimensions meet the orders here, before the far more numerous lines
    come in. Orders without a customer or region drop out. Orders that carry no
    ``region_id`` have that of their customer, from the same join. The regions are
    settled, a job that runs while the DataFrame is being built: there are few, each
    with many orders, and a broadcast, which Spark chooses by their true size, spares
    a shuffle on so few keys.
    """
    home = [] if "region_id" in orders.columns else ["region_id"]
    buyers = customers.select(
        "customer_id",
        *home,
        F.col("loyalty_status").alias("customer_loyalty_status"),
        full_name().alias("customer_full_name"),
    )
    places = settle(
        regions.select(
            "region_id",
            F.col("country").alias("region_country"),
            "region_name",
            F.col("manager").alias("region_manager"),
        ),
        "regions",
    )
    return (
        orders.join(buyers, "customer_id")
        .join(places, "region_id")
        .withColumn("delivery_time_days", F.col("delivery_time_days").cast("int"))
    )


#: Combinations of attributes up to which rows carry a number in their place.
FEW_KINDS = 50_000

ORDER_KIND = [
    "ship_mode", "payment_method", "order_priority", "customer_loyalty_status",
    "region_id", "region_country", "region_name", "region_manager",
]
PRODUCT_KIND = ["product_category", "product_subcategory", "product_supplier"]
LINE_KIND = ["quantity", "discount", "tax_rate"]


def numbered_kinds(
    df: DataFrame, columns: list[str], number: str, most: int = FEW_KINDS
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``number`` in place of ``columns``, and their values for each number.

    Texts with few combinations need not shuffle with every row. ``df`` as it is, and
    None, if there are more than ``most`` combinations. NULL is a value like others. An
    estimate comes first, so that far too many are not shuffled only to be refused.
    """
    if df.agg(F.approx_count_distinct(F.struct(*columns))).first()[0] > 2 * most:
        return df, None
    kinds = settle(
        df.select(*columns).distinct().limit(most + 1)
        .withColumn(number, F.monotonically_increasing_id()), number,
    )
    if kinds.count() > most:
        return df, None
    same = reduce(lambda a, b: a & b, (df[c].eqNullSafe(kinds[c]) for c in columns))
    others = [df[c] for c in df.columns if c not in columns]
    # at most ``most`` rows
    return df.join(F.broadcast(kinds), same).select(*others, number), kinds


def build_fact_sales(
    lines: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    regions: DataFrame,
    *,
    profit: Column | None = None,
    late: dict[str, Column] | None = None,
    high_value: float = HIGH_VALUE,
    bulk_quantity: int = BULK_QUANTITY,
    exact_shipping: bool = False,
    by_year: bool = False,
) -> DataFrame:
    """One row per order line whose order, customer, region and product exist.

    ``profit`` replaces the lines' own column by an expression over the line
    and its product, for sources that do not carry it; ``late`` does so for any of the lines'
    columns. Such columns are derived after the last shuffle, from what the lines carry in their
    place. Orders that carry an ``order_total`` keep it; for others the lines are summed here. Each line's shipping is
    its share of the order's, rounded; with ``exact_shipping`` the shares of an order's
    lines in the fact add up to it (``allocate_exactly``). ``by_year`` is for a fact that is
    then written by order year: the rows are rebalanced by it before they get what follows
    from their other columns, with a number for each combination of their classes, so that
    they shuffle narrow. Writers need not rebalance them again.

    The products come first, as their columns are narrower than the orders'. No side is forced
    to broadcast: small dimensions are, by Spark's size
    threshold, and large ones shuffle. The order side is settled first, so each
    remaining join has two plain shuffled inputs, and adaptive execution can
    split the partition of an order, customer or product that holds a large part
    of the lines. The per-order total is an aggregate with partial sums rather
    than a window, which would gather such an order in one task. Settling runs jobs
    while the DataFrame is being built.
    """
    if "order_total" not in orders.columns:
        orders = orders.join(order_totals(lines), "order_id")
    side = settle(order_side(orders, customers, regions), "order_side", SMALLEST)
    goods = products.select(
        "product_id",
        F.col("unit_price").cast(MONEY).alias("unit_price"),
        F.col("cost_price").cast(MONEY).alias("cost_price"),
        F.col("category").alias("product_category"),
        F.col("subcategory").alias("product_subcategory"),
        F.col("supplier").alias("product_supplier"),
    )
    late = dict(late or {})
    if profit is not None:
        late["profit"] = profit.cast(MONEY)
    lines = lines.withColumnRenamed("total_price", "revenue")
    lines = lines.select(*(c for c in (lines.columns if late else LINE_COLUMNS) if c not in late))
    kinds = []
    if by_year:
        side, of_orders = numbered_kinds(side, ORDER_KIND, "order_kind")
        goods, of_products = numbered_kinds(goods, PRODUCT_KIND, "product_kind")
        kinds = [(of_orders, "order_kind"), (of_products, "product_kind")]
        if not exact_shipping:
            lines, of_lines = numbered_kinds(lines, LINE_KIND, "line_kind")
            kinds.append((of_lines, "line_kind"))
    joined = lines.join(goods, "product_id").join(side, "order_id")
    share = allocate(F.col("shipping_cost"), F.col("revenue"), F.col("order_total"))
    if exact_shipping:
        joined = allocate_exactly(
            settle(joined.withColumns(late), "joined_lines"), "shipping_cost", "revenue",
            "order_id", "order_detail_id", "exact_share",
        )
        late, share = {}, F.col("exact_share")
    if by_year:
        year = order_date_parts()["order_year"]
        joined = joined.withColumn("order_year", year).hint("rebalance", F.col("order_year"))
        for found, number in kinds:
            if found is not None:
                joined = joined.join(F.broadcast(found), number)
    joined = joined.withColumns(late).withColumn("shipping_cost", share)
    return (
        joined.withColumns({**order_date_parts(), **line_measures()})
        .withColumns({"profit_margin": guarded_margin(), **line_flags(high_value, bulk_quantity)})
        .select(*FACT_COLUMNS)
    )


LINE_COLUMNS = [
    "order_detail_id", "order_id", "product_id", "quantity", "discount", "tax_rate",
    "revenue", "profit",
]

# The fact's columns, in the warehouse's order.
FACT_COLUMNS = [
    "order_date", "order_year", "order_quarter", "order_month", "order_month_name",
    "order_day", "order_day_name",
    "customer_id", "product_id", "region_id", "order_id", "order_detail_id",
    "quantity", "discount", "tax_rate", "unit_price", "cost_price",
    "revenue", "cost", "profit", "shipping_cost",
    "profit_margin", "discount_amount", "gross_amount",
    "ship_mode", "payment_method", "order_priority", "delivery_time_days",
    "is_loss_sale", "is_discounted", "is_high_value", "is_bulk_order",
    "region_country", "customer_loyalty_status", "customer_full_name",
    "product_category", "product_subcategory", "product_supplier",
    "region_name", "region_manager",
]


def overwrite_from(
    df: DataFrame, dimension: DataFrame, key: str, column: str, value: Column
) -> DataFrame:
    """Set ``column`` from the matching row of a dimension; keep it elsewhere.

    Adds the column when ``df`` does not have it.
    """
    found = dimension.select(key, value.alias("found"))
    kept = F.col(column) if column in df.columns else F.lit(None)
    return (
        df.join(found, key, "left").withColumn(column, F.coalesce("found", kept)).drop("found")
    )
