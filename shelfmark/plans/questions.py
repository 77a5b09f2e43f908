"""All business questions by name, over a warehouse and a set of parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans import customers, operations, products, regions, revenue, time_series


class Warehouse(Protocol):
    """The tables that the questions read."""

    fact: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    calendar: DataFrame


@dataclass(frozen=True)
class Parameters:
    """What the questions ask about.

    Fixed values: the defaults are those of the original retail data.
    """

    countries: tuple[str, ...] = ("Belgium", "Netherlands", "Luxembourg", "France", "Germany")
    discount_classes: tuple[tuple[float, str], ...] = customers.DISCOUNT_CLASSES
    delivery_limits: Mapping[str, int] = field(
        default_factory=lambda: dict(operations.DELIVERY_LIMITS)
    )
    partial_quarters: tuple[tuple[int, int], ...] = time_series.PARTIAL_QUARTERS
    product: object = "P137"
    as_of: date | None = date(2025, 11, 5)

    @property
    def as_of_day(self) -> Column | None:
        return None if self.as_of is None else F.lit(self.as_of)


Question = Callable[[Warehouse, Parameters], DataFrame]

QUESTIONS: dict[str, Question] = {
    "q01_revenue_by_year": lambda w, p: revenue.by_year(w.fact),
    "q02_revenue_by_quarter": lambda w, p: revenue.by_quarter(w.fact),
    "q03_revenue_by_month": lambda w, p: revenue.by_month(w.fact),
    "q04_margin_by_category": lambda w, p: revenue.margin_by_category(w.fact),
    "q05_margin_by_product": lambda w, p: products.margin_by_product(w.fact, w.products),
    "q06_margin_by_country": lambda w, p: revenue.margin_by_country(w.fact),
    "q07_top_products": lambda w, p: products.extreme_products(w.fact, w.products),
    "q08_bottom_products": lambda w, p: products.extreme_products(
        w.fact, w.products, best=False
    ),
    "q09_yearly_growth": lambda w, p: revenue.yearly_growth(w.fact),
    "q10_signups_by_month": lambda w, p: customers.signups_by_month(w.customers),
    "q11_orders_per_customer": lambda w, p: customers.orders_per_customer(w.fact),
    "q12_repeat_rate": lambda w, p: customers.repeat_rate(w.fact),
    "q13_lifetime_revenue": lambda w, p: customers.lifetime_value(w.fact),
    "q14_lifetime_profit": lambda w, p: customers.lifetime_value(w.fact, "profit", "revenue"),
    "q15_value_quintiles": lambda w, p: customers.value_quintiles(w.fact),
    "q16_loyalty_averages": lambda w, p: customers.by_loyalty(w.fact),
    "q17_customers_by_country": lambda w, p: customers.counts_by_country(
        w.customers, p.countries
    ),
    "q18_customer_shares": lambda w, p: customers.shares_by_country(w.customers, p.countries),
    "q19_discount_effect": lambda w, p: customers.discount_effect(w.fact, p.discount_classes),
    "q20_churn": lambda w, p: customers.churn(w.fact, p.as_of_day),
    "q21_products_by_revenue": lambda w, p: products.by_total(
        w.fact, w.products, "revenue", "total_revenue"
    ),
    "q22_products_by_quantity": lambda w, p: products.by_total(
        w.fact, w.products, "quantity", "total_quantity"
    ),
    "q23_products_by_profit": lambda w, p: products.by_total(
        w.fact, w.products, "profit", "total_profit"
    ),
    "q24_categories": lambda w, p: products.categories(w.fact),
    "q25_cross_selling": lambda w, p: products.cross_selling(w.fact),
    "q26_loss_lines": lambda w, p: products.loss_lines(w.fact),
    "q27_loss_summary": lambda w, p: products.loss_summary(w.fact),
    "q28_lines_of_product": lambda w, p: products.lines_of_product(
        w.fact, w.products, p.product
    ),
    "q29_lines_by_profit": lambda w, p: products.lines_by_profit(w.fact),
    "q30_revenue_by_stock_status": lambda w, p: products.by_stock_status(
        w.fact, w.products
    ),
    "q31_stock_status_shares": lambda w, p: products.stock_status_shares(
        w.fact, w.products
    ),
    "q32_low_stock": lambda w, p: products.restock_list(w.fact, w.products, "Low Stock"),
    "q33_out_of_stock_share": lambda w, p: products.stock_status_share(
        w.fact, w.products
    ),
    "q34_out_of_stock": lambda w, p: products.restock_list(
        w.fact, w.products, "Out of Stock"
    ),
    "q35_delivery_by_ship_mode": lambda w, p: operations.delivery_days(w.fact, "ship_mode"),
    "q36_on_time": lambda w, p: operations.on_time(w.orders, p.delivery_limits),
    "q37_shipping_share_by_order": lambda w, p: operations.shipping_share_by_order(w.fact),
    "q38_shipping_share": lambda w, p: operations.shipping_share(w.fact),
    "q39_delivery_by_priority": lambda w, p: operations.delivery_days(
        w.fact, "order_priority"
    ),
    "q40_revenue_by_country": lambda w, p: regions.revenue_by_country(w.fact),
    "q41_country_shares": lambda w, p: regions.country_shares(w.fact),
    "q42_country_growth": lambda w, p: regions.country_growth(w.fact),
    "q43_country_margins": lambda w, p: regions.country_margins(w.fact),
    "q44_manager_margins": lambda w, p: regions.manager_margins(w.fact),
    "q45_moving_average": lambda w, p: time_series.moving_average(w.fact),
    "q46_complete_quarters": lambda w, p: time_series.complete_quarters(
        w.fact, p.partial_quarters
    ),
    "q47_same_month_last_year": lambda w, p: time_series.same_month_last_year(
        w.fact, w.calendar
    ),
    "q48_avg_monthly_growth": lambda w, p: time_series.average_monthly_growth(w.fact),
    "q49_avg_quarterly_growth": lambda w, p: time_series.average_quarterly_growth(w.fact),
    "r01_payment_methods": lambda w, p: operations.payment_methods(w.fact),
    "r02_revenue_tree": lambda w, p: regions.revenue_tree(w.fact),
    "r03_top_five": lambda w, p: products.extreme_products(w.fact, w.products, 5),
    "r03_bottom_five": lambda w, p: products.extreme_products(
        w.fact, w.products, 5, best=False
    ),
    "r03_stock_alerts": lambda w, p: products.stock_alerts(w.fact, w.products),
    "r04_shipping_by_mode": lambda w, p: operations.shipping_by_mode(w.fact),
    "r05_rfm": lambda w, p: customers.rfm(w.fact, p.as_of_day),
    "r06_cohorts": lambda w, p: customers.cohort_retention(w.fact),
}
