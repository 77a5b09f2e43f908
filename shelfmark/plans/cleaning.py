"""Cleaning of the five retail tables.

Regions and customers come first: their mappings re-point the orders. Cleaned
products come before the lines, whose missing profits need the prices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import clean

# Accepted spellings of each category and their standard form, the
# loyalty of customers without one, and the cost share of products without a cost.
REGION_NAMES = {
    "benelux": "Benelux",
    "BENELUX": "Benelux",
    "western europe": "Western Europe",
    "Western EU": "Western Europe",
    "central europe": "Central Europe",
}
STOCK_STATUSES = {
    "in stock": "In Stock",
    "IN STOCK": "In Stock",
    "In stock": "In Stock",
    "low stock": "Low Stock",
    "LOW STOCK": "Low Stock",
    "Low stock": "Low Stock",
    "out of stock": "Out of Stock",
    "OUT OF STOCK": "Out of Stock",
}
SHIP_MODES = {
    "express": "Express",
    "EXPRESS": "Express",
    "standard": "Standard",
    "STANDARD": "Standard",
    "overnight": "Overnight",
    "economy": "Economy",
}
PAYMENT_METHODS = {
    "visa": "Visa",
    "VISA": "Visa",
    "mastercard": "Mastercard",
    "MASTERCARD": "Mastercard",
    "paypal": "PayPal",
    "PAYPAL": "PayPal",
    "bancontact": "Bancontact",
    "ideal": "iDEAL",
    "sepa": "SEPA",
}
ORDER_PRIORITIES = {
    "low": "Low",
    "LOW": "Low",
    "medium": "Medium",
    "MEDIUM": "Medium",
    "high": "High",
    "HIGH": "High",
    "urgent": "Urgent",
    "URGENT": "Urgent",
}
UNKNOWN_LOYALTY = "Unclassified"
COST_SHARE = 0.70


#: The columns that the cleaning of each table fills.
FILLED = {
    "customers": ["loyalty_status", "age"],
    "products": ["cost_price"],
    "orders": ["delivery_time_days"],
    "order_details": ["discount", "profit"],
}


@dataclass(frozen=True)
class Rules:
    """What the cleaning of all five tables can be told; the defaults are the fixed values."""

    region_names: dict[str, str] = field(default_factory=lambda: REGION_NAMES)
    stock_statuses: dict[str, str] = field(default_factory=lambda: STOCK_STATUSES)
    ship_modes: dict[str, str] = field(default_factory=lambda: SHIP_MODES)
    payment_methods: dict[str, str] = field(default_factory=lambda: PAYMENT_METHODS)
    order_priorities: dict[str, str] = field(default_factory=lambda: ORDER_PRIORITIES)
    na_tokens: tuple[str, ...] = ("",)
    unknown_loyalty: str = UNKNOWN_LOYALTY
    cost_share: float = COST_SHARE


ORIGINAL = Rules()


def clean_regions(
    raw: DataFrame, names: dict[str, str] = REGION_NAMES
) -> tuple[DataFrame, DataFrame]:
    """Conform, then merge rows with the same country, name and manager."""
    conformed = clean.conform(clean.to_title_case(raw, "country", "manager"), "region_name", names)
    return clean.merge_duplicates(conformed, ["country", "region_name", "manager"], "region_id", [])


def merge_customers(raw: DataFrame, key: str = "email") -> tuple[DataFrame, DataFrame]:
    """Merge customers with one address into the earliest signup, then lowest id."""
    earliest = [F.col("signup_date").isNull(), F.col("signup_date")]
    return clean.merge_duplicates(raw, [key], "customer_id", earliest)


def marked(df: DataFrame, table: str, counted: bool) -> DataFrame:
    """With the NULLs of each row that are to be filled, if they are to be counted."""
    return clean.mark_gaps(df, FILLED[table]) if counted else df


def clean_customers(
    raw: DataFrame, na_tokens: tuple[str, ...] = ("",), unknown_loyalty: str = UNKNOWN_LOYALTY,
    counted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Repair emails, merge, fill loyalty and age, flag missing signups, title-case.

    ``na_tokens`` are loyalty texts that mean "no value".
    """
    loyalty = F.col("loyalty_status")
    known = raw.withColumn("loyalty_status", F.when(~loyalty.isin(*na_tokens), loyalty))
    merged, mapping = merge_customers(clean.repair_emails(known))
    merged = marked(merged, "customers", counted)
    filled = clean.fill_constants(merged, {"loyalty_status": unknown_loyalty})
    filled = clean.fill_group_median(filled, "age", "country")
    flagged = clean.flag_missing(filled, "signup_date", "signup_date_missing")
    return clean.to_title_case(flagged, "country", "city"), mapping


def clean_products(raw: DataFrame, rules: Rules = ORIGINAL, counted: bool = False) -> DataFrame:
    """Conform the stock status and impute missing costs from the unit price.

    The imputed cost is a double with all its digits; it becomes a decimal when
    the fact is built.
    """
    raw = marked(raw, "products", counted)
    status = clean.conform(raw, "stock_status", rules.stock_statuses)
    flagged = clean.flag_missing(status, "cost_price", "cost_price_imputed")
    as_double = flagged.withColumn("cost_price", F.col("cost_price").cast("double"))
    estimate = F.col("unit_price").cast("double") * rules.cost_share
    costed = clean.fill_from(as_double, "cost_price", estimate)
    return clean.to_title_case(costed, "category", "subcategory")


def repoint_orders(orders: DataFrame, customer_map: DataFrame, region_map: DataFrame) -> DataFrame:
    moved = clean.repoint(orders, "region_id", region_map)
    return clean.repoint(moved, "customer_id", customer_map).select(*orders.columns)


def conform_orders(orders: DataFrame, rules: Rules = ORIGINAL) -> DataFrame:
    by_mode = clean.conform(orders, "ship_mode", rules.ship_modes)
    by_payment = clean.conform(by_mode, "payment_method", rules.payment_methods)
    return clean.conform(by_payment, "order_priority", rules.order_priorities)


def clean_orders(
    raw: DataFrame, customer_map: DataFrame, region_map: DataFrame, rules: Rules = ORIGINAL,
    counted: bool = False,
) -> DataFrame:
    """Conform categories, fill delivery days by ship mode, re-point merged ids.

    The ids play no part in the first two steps. Doing those first lets the pass
    for the medians read the raw orders alone, without the mapping joins.
    """
    raw = marked(raw, "orders", counted)
    filled = clean.fill_group_median(conform_orders(raw, rules), "delivery_time_days", "ship_mode")
    return repoint_orders(filled, customer_map, region_map)


def drop_duplicate_lines(raw: DataFrame) -> DataFrame:
    """Keep the lowest line id per order, product and quantity."""
    keys = ["order_id", "product_id", "quantity"]
    others = [c for c in raw.columns if c not in (*keys, "order_detail_id")]
    order = [F.col(c).asc_nulls_last() for c in ("order_detail_id", *others)]
    return clean.keep_first(raw, keys, order)


def clean_order_details(
    raw: DataFrame, products: DataFrame, counted: bool = False
) -> DataFrame:
    """Drop duplicates, then fill discounts and profits, then flag losses."""
    single = marked(drop_duplicate_lines(raw), "order_details", counted)
    priced = clean.fill_constants(single, {"discount": 0})
    return clean.flag_losses(clean.fill_line_profit(priced, products))
