"""The retail model over the order-and-line tables of a Parquet directory.

The directory holds ``region nation customer part orders lineitem events``. Its
keys are integers and stay so: they shuffle and compare faster than text. What
those tables lack is filled by stand-ins, listed in the README.

``Shop`` gives the clean model and its sales fact; ``RawShop`` gives the same
tables with the kinds of dirt that cleaning is for, derived from the keys.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.star import build_fact_sales
from shelfmark.sources.shared import SMALLEST, new_table_path
from shelfmark.sources.tables import write_table

MONEY = "decimal(10,2)"
RATE = "decimal(5,2)"

HIGH_VALUE = 50_000
BULK_QUANTITY = 25
UNIT_COST_SHARE = 0.70
SHIP_MODES = {
    "1-URGENT": "Overnight",
    "2-HIGH": "Express",
    "3-MEDIUM": "Standard",
    "4-NOT SPECIFIED": "Standard",
    "5-LOW": "Economy",
}
PRIORITIES = {
    "1-URGENT": "Urgent",
    "2-HIGH": "High",
    "3-MEDIUM": "Medium",
    "4-NOT SPECIFIED": "Not Specified",
    "5-LOW": "Low",
}
PAYMENTS = {"F": "Visa", "O": "Mastercard", "P": "PayPal"}


def _lookup(column: str, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


class Amounts(NamedTuple):
    """Expressions over a line of the given tables."""

    rebate: Column
    tax: Column
    net: Column
    total: Column


class Shop:
    """The clean retail tables of one directory; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("region_id"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region_name"),
            F.col("r_name").alias("manager"),
        )

    @cached_property
    def signups(self) -> DataFrame:
        return (
            self.table("events")
            .filter("event_type = 'signup'")
            .groupBy(F.col("user_id").alias("customer_id"))
            .agg(F.to_date(F.min("ts")).alias("signup_date"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        name = F.col("c_name")
        return (
            self.table("customer")
            .join(nation, "c_nationkey", "left")
            .withColumn("customer_id", F.col("c_custkey"))
            .join(self.signups, "customer_id", "left")
            .select(
                "customer_id",
                F.split_part(name, F.lit("#"), F.lit(1)).alias("first_name"),
                F.split_part(name, F.lit("#"), F.lit(2)).alias("last_name"),
                F.col("n_name").alias("country"),
                F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("city"),
                F.concat(F.lower(name), F.lit("@gmail.com")).alias("email"),
                "signup_date",
                F.col("c_mktsegment").alias("loyalty_status"),
                (F.pmod(F.floor("c_acctbal"), F.lit(48)) + 23).cast("int").alias("age"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        size = F.col("p_size")
        stock = F.when(size <= 10, "Out of Stock").when(size <= 30, "Low Stock")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            F.round(F.col("p_retailprice") / UNIT_COST_SHARE, 2).cast(MONEY).alias("unit_price"),
            F.col("p_retailprice").cast(MONEY).alias("cost_price"),
            F.concat(F.lit("Supplier of "), F.col("p_brand")).alias("supplier"),
            stock.otherwise("In Stock").alias("stock_status"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """Last ship date of each order."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.to_date(F.max("l_shipdate")).alias("delivered"))
        )

    @cached_property
    def placed_orders(self) -> DataFrame:
        """The orders without their region, which costs a join with the customers.

        The delivery days cost one too, but there each order occurs once in an
        aggregate, so Catalyst drops the join where they are not asked for.
        """
        return self._with_days(self._dated_orders.join(self.deliveries, "order_id", "left"))

    @property
    def _dated_orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            _lookup("o_orderpriority", SHIP_MODES).alias("ship_mode"),
            _lookup("o_orderstatus", PAYMENTS).alias("payment_method"),
            F.col("o_totalprice").cast(MONEY).alias("shipping_cost"),
            _lookup("o_orderpriority", PRIORITIES).alias("order_priority"),
        )

    @staticmethod
    def _with_days(orders: DataFrame) -> DataFrame:
        days = F.datediff("delivered", "order_date")
        return orders.withColumn("delivery_time_days", F.when(days >= 0, days)).drop("delivered")

    @cached_property
    def summed_orders(self) -> DataFrame:
        """The placed orders that have lines, with delivery days and order total.

        Both come from one aggregate of the lines.
        """
        total = F.sum(self._net().total).alias("order_total")
        delivered = F.to_date(F.max("l_shipdate")).alias("delivered")
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
        return self._with_days(self._dated_orders.join(lines.agg(total, delivered), "order_id"))

    @cached_property
    def buyers(self) -> DataFrame:
        """The customers' columns of the fact, and their region."""
        name = F.col("c_name")
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.split_part(name, F.lit("#"), F.lit(1)).alias("first_name"),
            F.split_part(name, F.lit("#"), F.lit(2)).alias("last_name"),
            F.col("c_mktsegment").alias("loyalty_status"),
            F.col("c_nationkey").alias("region_id"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        homes = self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("region_id")
        )
        return self.placed_orders.join(homes, "customer_id", "left")

    @staticmethod
    def _amounts(price: Column, rebate: Column, tax: Column) -> Amounts:
        one = F.lit(1).cast(RATE)
        net = price * (one - rebate)
        return Amounts(rebate, tax, net.cast(MONEY), (net * (one + tax)).cast(MONEY))

    @classmethod
    def _net(cls) -> Amounts:
        rates = (F.col(c).cast(RATE) for c in ("l_discount", "l_tax"))
        return cls._amounts(F.col("l_extendedprice").cast(MONEY), *rates)

    @property
    def fact_lines(self) -> tuple[DataFrame, dict[str, Column]]:
        """The fact's lines with what their amounts and id are derived from, and how.

        List price and line number shuffle in place of three columns of more digits.
        """
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_discount").cast(RATE).alias("discount"),
            F.col("l_tax").cast(RATE).alias("tax_rate"),
            F.col("l_extendedprice").cast(MONEY).alias("list_price"),
        )
        amounts = self._amounts(F.col("list_price"), F.col("discount"), F.col("tax_rate"))
        return lines, {
            "order_detail_id": F.col("order_id") * 20 + F.col("line_number"),
            "revenue": amounts.total,
            "profit": self.line_profit("cost_price", amounts.net),
        }

    @cached_property
    def unpriced_lines(self) -> DataFrame:
        """Order lines with ``net_amount`` in place of the profit."""
        rebate, tax, net, total = self._net()
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 20 + F.col("l_linenumber")).alias("order_detail_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            rebate.alias("discount"),
            tax.alias("tax_rate"),
            total.alias("total_price"),
            net.alias("net_amount"),
        )

    @staticmethod
    def line_profit(cost_price: str, net_amount: Column | None = None) -> Column:
        """Net amount, by default the line's own column, less the cost."""
        spent = F.col(cost_price) * F.col("quantity").cast("decimal(10,0)")
        return ((F.col("net_amount") if net_amount is None else net_amount) - spent).cast(MONEY)

    @cached_property
    def order_details(self) -> DataFrame:
        costs = self.products.select("product_id", F.col("cost_price").alias("unit_cost"))
        return (
            self.unpriced_lines.join(costs, "product_id", "left")
            .withColumn("profit", self.line_profit("unit_cost"))
            .drop("unit_cost", "net_amount")
        )

    @cached_property
    def fact(self) -> DataFrame:
        """The sales fact, written once to the shared folder on first use.

        The lines' profit is taken from the product columns that the fact joins
        anyway, which saves the join inside ``order_details``; the region comes with
        the customer's other columns.
        """
        lines, late = self.fact_lines
        fact = build_fact_sales(
            lines, self.summed_orders, self.buyers, self.products, self.regions, late=late,
            high_value=HIGH_VALUE, bulk_quantity=BULK_QUANTITY, by_year=True,
        )
        path = new_table_path(self.spark, "fact_sales")
        write_table(fact, path, "order_year", compression=SMALLEST)
        return self.spark.read.schema(fact.schema).parquet(path)


class RawShop(Shop):
    """The retail tables before cleaning."""

    @cached_property
    def clean(self) -> Shop:
        return Shop(self.spark, self.folder)

    @cached_property
    def regions(self) -> DataFrame:
        """Every fifth country occurs twice, in other spellings."""
        twice = F.when(F.col("region_id") % 5 == 0, 2).otherwise(1)
        copy = F.col("copy") == 2
        return (
            self.clean.regions.withColumn("copy", F.explode(F.sequence(F.lit(1), twice)))
            .withColumns(
                {
                    "region_id": F.when(copy, F.col("region_id") + 100).otherwise(
                        F.col("region_id")
                    ),
                    "country": F.when(copy, F.lower("country")).otherwise(F.col("country")),
                    "region_name": F.when(copy, F.lower("region_name")).otherwise(
                        F.col("region_name")
                    ),
                    "manager": F.when(copy, F.lower("manager")).otherwise(F.col("manager")),
                }
            )
            .drop("copy")
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Damaged, missing and shared addresses; missing loyalty and ages."""
        key = F.col("customer_id")
        sharer = F.when(key % 10 == 1, key - 1).otherwise(key)
        host = F.when(key % 20 == 1, "gmail.com").otherwise("@gmail.com")
        address = F.concat(F.lit("customer#"), F.lpad(sharer.cast("string"), 9, "0"), host)
        cased = F.when(key % 7 == 0, F.concat(F.lit(" "), F.upper(address))).otherwise(address)
        return self.clean.customers.withColumns(
            {
                "email": F.when(key % 33 != 0, cased),
                "loyalty_status": F.when(key % 5 != 0, F.col("loyalty_status")),
                "age": F.when(key % 13 != 0, F.col("age")),
            }
        )

    @cached_property
    def products(self) -> DataFrame:
        key, status = F.col("product_id"), F.col("stock_status")
        cased = F.when(key % 4 == 0, F.lower(status)).when(key % 4 == 1, F.upper(status))
        return self.clean.products.withColumns(
            {
                "stock_status": cased.otherwise(status),
                "cost_price": F.when(key % 10 != 0, F.col("cost_price")),
                "category": F.when(key % 4 == 0, F.lower("category")).otherwise(
                    F.col("category")
                ),
            }
        )

    @staticmethod
    def _spoil_orders(orders: DataFrame) -> DataFrame:
        key = F.col("order_id")

        def cased(column: str) -> Column:
            spelled = F.when(key % 3 == 0, F.lower(column)).when(key % 3 == 1, F.upper(column))
            return spelled.otherwise(F.col(column))

        orphan = F.when(key % 500 == 0, -1 - F.col("customer_id"))
        texts = {c: cased(c) for c in ("ship_mode", "payment_method", "order_priority")}
        return orders.withColumns(
            {**texts, "customer_id": orphan.otherwise(F.col("customer_id"))}
        )

    @cached_property
    def placed_orders(self) -> DataFrame:
        """Spellings and orphan customers."""
        return self._spoil_orders(self.clean.placed_orders)

    @cached_property
    def orders(self) -> DataFrame:
        """As the placed orders, with references to doubled regions."""
        region = F.col("region_id")
        doubled = (region % 5 == 0) & (F.col("order_id") % 2 == 0)
        return self._spoil_orders(self.clean.orders).withColumn(
            "region_id", F.when(doubled, region + 100).otherwise(region)
        )

    @staticmethod
    def _spoil_lines(lines: DataFrame) -> DataFrame:
        key, product = F.col("order_id"), F.col("product_id")
        copies = F.when(key % 50 == 0, 2).otherwise(1)
        return (
            lines.withColumns(
                {
                    "discount": F.when(key % 7 != 0, F.col("discount")),
                    "product_id": F.when(key % 700 == 0, -1 - product).otherwise(product),
                }
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
            .withColumn("order_detail_id", F.col("order_detail_id") + F.col("copy") * 10)
            .drop("copy")
        )

    @cached_property
    def unpriced_lines(self) -> DataFrame:
        """Missing discounts, unknown products, every line of each 50th order twice."""
        return self._spoil_lines(self.clean.unpriced_lines)

    @property
    def fact_lines(self) -> tuple[DataFrame, dict[str, Column]]:
        """The unpriced lines: their amounts are those before the discounts went missing."""
        return self.unpriced_lines, {"profit": self.line_profit("cost_price")}

    @cached_property
    def order_details(self) -> DataFrame:
        """As the unpriced lines, with missing profits."""
        known = F.when(F.col("order_id") % 11 != 0, F.col("profit"))
        return self._spoil_lines(self.clean.order_details.withColumn("profit", known))
