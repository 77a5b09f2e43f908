"""The profile and the audits of raw retail tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import audit, clean

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
MEDIAN = {"median": 0.5}
LINE = ["order_detail_id", "order_id", "product_id"]


def profile_raw(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Audits of the tables ``regions customers products orders order_details``."""
    customers, orders, lines = raw["customers"], raw["orders"], raw["order_details"]
    products, regions = raw["products"], raw["regions"]
    return {
        **{f"nulls_{name}": audit.null_counts(df) for name, df in raw.items()},
        "orders_without_customer": audit.orphans(
            orders, customers, "customer_id", audit.NO_CUSTOMER,
            ["order_id", "customer_id", "order_date"],
        ),
        "orders_without_region": audit.orphans(
            orders, regions, "region_id", audit.NO_REGION, ["order_id", "region_id", "order_date"]
        ),
        "lines_without_order": audit.orphans(lines, orders, "order_id", audit.NO_ORDER, LINE),
        "lines_without_product": audit.orphans(
            lines, products, "product_id", audit.NO_PRODUCT, LINE
        ),
        "signup_range": audit.value_range(
            customers, "signup_date", "earliest_signup", "latest_signup"
        ),
        "order_range": audit.value_range(orders, "order_date", "earliest_order", "latest_order"),
        "ages": audit.profile_with_percentiles(customers, "age", QUARTILES, few_values=True),
        "customers_by_age": audit.by_extreme(
            customers, "age", "customer_id",
            ["customer_id", "first_name", "last_name", "country", "age"],
        ),
        "known_profits": audit.count_present(lines, "profit"),
        "profit_signs": audit.sign_split(lines, "profit"),
        "profits": audit.profile(lines, "profit"),
        "prices": audit.profile_with_percentiles(products, "unit_price", MEDIAN),
        "extreme_prices": audit.outside_band(
            products.select("product_id", "product_name", "category", "unit_price"),
            "unit_price", "product_id",
        ),
        "discounts": audit.profile_with_percentiles(lines, "discount", MEDIAN, few_values=True),
        "shared_emails": audit.duplicate_census(clean.repair_emails(customers), "email"),
        **{
            f"values_{column}": audit.value_counts(orders, column).orderBy(F.desc("row_count"))
            for column in ("region_id", "ship_mode", "payment_method", "order_priority")
        },
    }
