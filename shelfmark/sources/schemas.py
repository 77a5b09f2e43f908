"""Fixed schemas of the retail tables; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql.types import StructType

REGIONS = "region_id string, country string, region_name string, manager string"
CUSTOMERS = (
    "customer_id string, first_name string, last_name string, country string, city string, "
    "email string, signup_date date, loyalty_status string, age int"
)
PRODUCTS = (
    "product_id string, product_name string, category string, subcategory string, "
    "unit_price decimal(10,2), cost_price decimal(10,2), supplier string, stock_status string"
)
ORDERS = (
    "order_id string, order_date date, customer_id string, region_id string, ship_mode string, "
    "payment_method string, delivery_time_days int, shipping_cost decimal(10,2), "
    "order_priority string"
)
ORDER_DETAILS = (
    "order_detail_id string, order_id string, product_id string, quantity int, "
    "discount decimal(5,2), tax_rate decimal(5,2), total_price decimal(10,2), "
    "profit decimal(10,2)"
)
CUSTOMER_MAPPING = "old_customer_id string, new_customer_id string"
REGION_MAPPING = "old_region_id string, new_region_id string"

# What cleaning adds; an imputed cost keeps all its digits, hence the double,
# and a median may lie halfway between two whole numbers.
PRODUCTS_CLEANED = PRODUCTS.replace("cost_price decimal(10,2)", "cost_price double") + (
    ", cost_price_imputed boolean"
)
CUSTOMERS_CLEANED = CUSTOMERS.replace("age int", "age double") + (
    ", email_original string, signup_date_missing boolean"
)
ORDERS_CLEANED = ORDERS.replace("delivery_time_days int", "delivery_time_days double")
ORDER_DETAILS_CLEANED = ORDER_DETAILS + ", is_loss_sale boolean"

RAW = {
    "regions": REGIONS,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_details": ORDER_DETAILS,
}
CLEANED = {
    "regions": REGIONS,
    "customers": CUSTOMERS_CLEANED,
    "products": PRODUCTS_CLEANED,
    "orders": ORDERS_CLEANED,
    "order_details": ORDER_DETAILS_CLEANED,
    "customer_id_mapping": CUSTOMER_MAPPING,
    "region_id_mapping": REGION_MAPPING,
}

FACT_SALES = (
    "order_date date, order_quarter int, order_month int, order_month_name string, "
    "order_day int, order_day_name string, customer_id string, product_id string, "
    "region_id string, order_id string, order_detail_id string, quantity int, "
    "discount decimal(5,2), tax_rate decimal(5,2), unit_price decimal(10,2), "
    "cost_price decimal(10,2), revenue decimal(10,2), cost decimal(10,2), "
    "profit decimal(10,2), shipping_cost decimal(10,2), profit_margin decimal(18,4), "
    "discount_amount decimal(10,2), gross_amount decimal(10,2), ship_mode string, "
    "payment_method string, order_priority string, delivery_time_days int, "
    "is_loss_sale boolean, is_discounted boolean, is_high_value boolean, "
    "is_bulk_order boolean, region_country string, customer_loyalty_status string, "
    "customer_full_name string, product_category string, product_subcategory string, "
    "product_supplier string, region_name string, region_manager string, order_year int"
)
DIM_DATE = (
    "date_key int, full_date date, year int, year_name string, quarter int, "
    "quarter_name string, month int, month_name string, month_name_short string, "
    "month_year string, week_of_year int, day int, day_of_week int, day_name string, "
    "day_name_short string, is_weekend boolean, is_weekday boolean"
)
REJECTS = "table_name string, column_name string, value string"
CLEANING_REPORT = (
    "table_name string, rows_before bigint, rows_after bigint, rows_removed bigint, "
    "nulls_before bigint, nulls_after bigint, filled bigint, rejected bigint"
)
WAREHOUSE = {
    **CLEANED, "fact_sales": FACT_SALES, "dim_date": DIM_DATE, "rejects": REJECTS,
    "cleaning_report": CLEANING_REPORT,
}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
