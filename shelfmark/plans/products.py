"""Product questions.

A question that needs product attributes first reduces the fact to one row per
product and only then looks them up, so the join sees products, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.measures import margin_percent, percent, percent_of_all

PRODUCT_KEYS = ("product_id", "product_category")


def per_product(
    fact: DataFrame, products: DataFrame, *measures: Column, keys: tuple[str, ...] = PRODUCT_KEYS
) -> DataFrame:
    """The measures per product, with the product's name."""
    names = products.select("product_id", "product_name")
    return fact.groupBy(*keys).agg(*measures).join(names, "product_id")


def margin_by_product(fact: DataFrame, products: DataFrame) -> DataFrame:
    return per_product(
        fact,
        products,
        F.sum("profit").alias("total_profit"),
        F.sum("revenue").alias("total_revenue"),
        margin_percent().alias("profit_margin_pct"),
    ).orderBy(F.desc("profit_margin_pct"), "product_id")


def extreme_products(
    fact: DataFrame, products: DataFrame, count: int = 10, best: bool = True
) -> DataFrame:
    """The ``count`` products with the most (or least) profit; ties by id."""
    profit = F.col("total_profit").desc() if best else F.col("total_profit").asc()
    top = (
        fact.groupBy(*PRODUCT_KEYS, "product_supplier")
        .agg(F.sum("profit").alias("total_profit"))
        .orderBy(profit, "product_id")
        .limit(count)
    )
    place = F.row_number().over(Window.orderBy(profit, "product_id"))  # over ``count`` rows
    names = products.select("product_id", "product_name")
    return top.withColumn("profit_rank", place).join(names, "product_id").orderBy("profit_rank")


def by_total(fact: DataFrame, products: DataFrame, column: str, name: str) -> DataFrame:
    """Products by the sum of a fact column, largest first."""
    summed = per_product(fact, products, F.sum(column).alias(name))
    return summed.orderBy(F.desc(name), "product_id")


def categories(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("product_category")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("profit").alias("total_profit"),
            margin_percent().alias("profit_margin_pct"),
        )
        .orderBy(F.desc("profit_margin_pct"))
    )


def cross_selling(fact: DataFrame) -> DataFrame:
    """Orders by the number of categories they hold, and their share."""
    spread = fact.groupBy("order_id").agg(
        F.countDistinct("product_category").alias("categories_per_order")
    )
    return (
        spread.groupBy("categories_per_order")
        .agg(F.count("*").alias("order_count"))
        .withColumn("pct_of_orders", percent_of_all("order_count", digits=None))
        .orderBy("categories_per_order")
    )


def loss_lines(fact: DataFrame) -> DataFrame:
    """Lines sold at a loss, worst first."""
    return (
        fact.filter("profit < 0")
        .select(
            "product_id", "order_id", "order_detail_id",
            "revenue", "cost", "profit", "discount", "discount_amount",
        )
        .orderBy("profit", "order_id", "order_detail_id")
    )


def loss_summary(fact: DataFrame) -> DataFrame:
    return fact.filter("profit < 0").agg(
        F.count("*").alias("loss_lines"),
        F.sum("profit").alias("total_losses"),
        F.countDistinct("product_id").alias("products_with_losses"),
        F.countDistinct("order_id").alias("orders_with_losses"),
    )


def lines_of_product(fact: DataFrame, products: DataFrame, product_id: object) -> DataFrame:
    """All lines of one product, worst profit first; none if the product is not known.

    Its rows are counted and its name is looked up as one value each, so the lines are
    neither joined nor shuffled by the one id. Of several names for the id it is the
    first; a known product may have none.
    """
    wanted = F.col("product_id") == product_id
    rows = products.filter(wanted).agg(F.count("*")).scalar()
    name = products.filter(wanted).agg(F.min("product_name")).scalar()
    return (
        fact.filter(wanted)
        .filter(rows > 0)
        .select("product_id", "order_id", "order_detail_id", "product_category", "profit")
        .withColumn("product_name", name)
        .orderBy("profit", "order_id", "order_detail_id")
    )


def lines_by_profit(fact: DataFrame) -> DataFrame:
    """Every line, worst profit first. The ids keep equal profits sortable in parts."""
    return fact.select(
        "product_id", "product_category", "profit", "order_id", "order_detail_id"
    ).orderBy("profit", "order_id", "order_detail_id")


def _stock_revenue(fact: DataFrame, products: DataFrame) -> DataFrame:
    per_id = fact.groupBy("product_id").agg(F.sum("revenue").alias("revenue"))
    return (
        per_id.join(products.select("product_id", "stock_status"), "product_id")
        .groupBy("stock_status")
        .agg(F.sum("revenue").alias("total_revenue"))
    )


def by_stock_status(fact: DataFrame, products: DataFrame) -> DataFrame:
    return _stock_revenue(fact, products).orderBy(F.desc("total_revenue"))


def stock_status_shares(fact: DataFrame, products: DataFrame) -> DataFrame:
    return _stock_revenue(fact, products).withColumn(
        "pct_of_revenue", percent_of_all("total_revenue")
    )


def stock_status_share(
    fact: DataFrame, products: DataFrame, status: str = "Out of Stock"
) -> DataFrame:
    """One number: the percentage of all revenue from products in ``status``."""
    part = F.sum(F.when(F.col("stock_status") == status, F.col("total_revenue")))
    return _stock_revenue(fact, products).agg(
        percent(part, F.sum("total_revenue"), digits=None).alias("pct_of_revenue")
    )


def restock_list(fact: DataFrame, products: DataFrame, status: str) -> DataFrame:
    """Products in ``status`` that sold, by revenue."""
    wanted = products.filter(F.col("stock_status") == status)
    return (
        fact.groupBy("product_id")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.count("*").alias("times_sold"),
            F.sum("quantity").alias("total_quantity"),
        )
        .join(wanted.select("product_id", "product_name", "stock_status"), "product_id")
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def stock_alerts(
    fact: DataFrame,
    products: DataFrame,
    statuses: tuple[str, ...] = ("Low Stock", "Out of Stock"),
) -> DataFrame:
    """Restock lists of several statuses in one pass, ranked inside each."""
    sold = fact.groupBy("product_id").agg(
        F.sum("revenue").alias("total_revenue"), F.sum("quantity").alias("total_quantity")
    )
    wanted = products.filter(F.col("stock_status").isin(*statuses))
    return sold.join(
        wanted.select("product_id", "product_name", "stock_status"), "product_id"
    ).orderBy("stock_status", F.desc("total_revenue"), "product_id")
