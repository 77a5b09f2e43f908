"""The fact written by year: the same rows, shuffled narrow."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import Tables, tables_of
from shelfmark.operators import star
from shelfmark.sources import buckets, shop as shop_tables, versions
from tests.test_physical import SF, plan_of


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


@pytest.mark.parametrize("few", [star.FEW_KINDS, 3])
def test_by_year_the_fact_is_the_same(spark, monkeypatch, few):
    """Also if there are more combinations than are numbered."""
    shop = tables_of(spark, SF).shop
    sides = (shop.order_details, shop.orders, shop.customers, shop.products, shop.regions)
    plain = star.build_fact_sales(*sides)
    monkeypatch.setattr(star.numbered_kinds, "__defaults__", (few,))
    built = star.build_fact_sales(*sides, by_year=True)
    assert built.columns == star.FACT_COLUMNS and built.dtypes == plain.dtypes
    assert rows(built) == rows(plain)


def test_classes_of_orders_and_products_do_not_shuffle_by_year(spark):
    shop = tables_of(spark, SF).shop
    built = star.build_fact_sales(
        shop.order_details, shop.orders, shop.customers, shop.products, shop.regions, by_year=True
    )
    logical = built._jdf.queryExecution().optimizedPlan().toString()
    below = logical[logical.index("RebalancePartitions") :].splitlines()[1]
    assert below.lstrip(" :+-").startswith("Project")
    texts = [*star.ORDER_KIND, *star.PRODUCT_KIND, "order_month_name", "gross_amount"]
    assert not [c for c in texts if re.search(rf"\b{c}#", below)]
    plan = plan_of(built)
    assert plan.count("REBALANCE_PARTITIONS") == 1


def test_lines_shuffle_without_what_is_derived_from_them(spark, monkeypatch):
    """The shop's fact: list price and line number until all rows have met, small numbers once."""
    built = []
    monkeypatch.setattr(shop_tables, "write_table", lambda df, *_, **__: built.append(df))
    tables = Tables(spark, SF)
    monkeypatch.setattr(type(spark.read), "parquet", _not_written(type(spark.read).parquet))
    fact = tables.shop.fact
    monkeypatch.undo()
    assert fact is None
    logical = built[0]._jdf.queryExecution().optimizedPlan().toString()
    below = logical[logical.index("RebalancePartitions") :].splitlines()[1]
    late = ["revenue", "profit", "order_detail_id", *star.LINE_KIND]
    assert not [c for c in late if re.search(rf"\b{c}#", below)]
    sides = (tables.shop.orders, tables.shop.customers, tables.shop.products, tables.shop.regions)
    plain = star.build_fact_sales(
        tables.shop.order_details, *sides,
        high_value=shop_tables.HIGH_VALUE, bulk_quantity=shop_tables.BULK_QUANTITY,
    )
    assert built[0].dtypes == plain.dtypes and rows(built[0]) == rows(plain)


def _not_written(real):
    """Spark's reader of Parquet, but None for a fact that a test kept from being written."""
    return lambda self, *paths: None if "fact_sales" in paths[0] else real(self, *paths)


@pytest.mark.parametrize("exact", [False, True])
def test_late_columns_of_any_build(spark, exact):
    """Plain or by year, with rounded or exact shares."""
    shop = tables_of(spark, SF).shop
    sides = (shop.summed_orders, shop.buyers, shop.products, shop.regions)
    lines, late = shop.fact_lines
    found = [
        star.build_fact_sales(lines, *sides, late=late, exact_shipping=exact, by_year=by_year)
        for by_year in (False, True)
    ]
    plain = star.build_fact_sales(shop.order_details, *sides, exact_shipping=exact)
    assert rows(found[0]) == rows(found[1]) == rows(plain)


def test_the_raw_fact_keeps_amounts_of_lines_without_discount(spark):
    raw = tables_of(spark, SF).raw
    lost = raw.fact.filter("discount is null").select("order_id", "product_id", "revenue")
    assert lost.count() > 0 and lost.filter("revenue is null").count() == 0


def test_far_too_many_kinds_are_not_shuffled_to_be_refused(spark, monkeypatch):
    monkeypatch.setattr(star, "settle", lambda *_: pytest.fail("written"))
    df = spark.range(500).selectExpr("id", "id as p")
    same, none = star.numbered_kinds(df, ["p"], "kind", 100)
    assert none is None and same.columns == ["id", "p"]


def test_kinds_are_numbered_once_also_null(spark):
    df = spark.createDataFrame(
        [(i, ["a", None][i % 2], ["x", "y", None][i % 3]) for i in range(60)],
        "id long, p string, q string",
    )
    coded, kinds = star.numbered_kinds(df, ["p", "q"], "kind", 6)
    assert kinds.count() == 6 and coded.columns == ["id", "kind"]
    assert rows(coded.join(kinds, "kind").drop("kind")) == rows(df)
    same, none = star.numbered_kinds(df, ["p", "q"], "kind", 5)
    assert none is None and same.columns == df.columns
    assert same.agg(F.count("*")).first()[0] == 60


def test_exact_shares_shuffle_the_lines_once(spark):
    """Sizes and lines meet once; what is given away is summed in the window that ranks."""
    df = spark.range(500).selectExpr(
        "id div 5 as o", "id as l", "cast(100.01 as decimal(10,2)) as amount",
        "cast(id % 7 as decimal(10,2)) as part",
    )
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        found = star.allocate_exactly(df, "amount", "part", "o", "l", "share")
        plan = plan_of(found)
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("SortMergeJoin") == 1 and len(re.findall(r"\bWindow \[", plan)) == 1
    assert found.groupBy("o").agg(F.sum("share").alias("s")).filter("s <> 100.01").count() == 0


def test_buckets_follow_the_rows(spark):
    df = spark.range(1000).selectExpr("id % 300 as p", "id as v")
    number = buckets.enough_buckets(df, least=2, rows=100)
    assert (number, buckets.enough_buckets(df)) == (10, 8)
    kept = buckets.write_bucketed(df, "p", number, "sold")
    dimension = buckets.write_dimension(df.select("p").distinct(), "p", number, "goods")
    assert f"Num Buckets|{number}" in "\n".join(
        f"{r.col_name}|{r.data_type}" for r in spark.sql(f"describe formatted {kept.cool}").collect()
    )
    assert rows(kept.join(spark, dimension)) == rows(df)
    buckets.drop(spark, kept.cool, dimension)


def test_a_balanced_table_is_not_rebalanced_again(spark, tmp_path):
    """Cut from 64 tasks without a rebalance, a value has a file of each."""
    rows_ = spark.range(0, 6400, 1, 64).withColumn("y", F.col("id") % 2)
    build = versions.Build(spark, str(tmp_path))
    build.write("dealt", rows_.repartition(2, "y"), cut_by="y", balanced=True)
    build.write("raw", rows_, cut_by="y", balanced=True)
    build.write("even", rows_, cut_by="y")
    files = {n: len(list(tmp_path.glob(f"{n}/y=0/*/*.parquet"))) for n in ("dealt", "raw", "even")}
    assert files["dealt"] == 1 and files["raw"] == 64 and files["even"] < 64
    assert rows(build.read("dealt")) == rows(build.read("even")) == rows(rows_)


def test_lines_of_a_month_are_found_without_a_shuffle(spark, monkeypatch):
    plans = []
    real = versions.Build.write

    def write(self, name, df, *args, **options):
        if name == "order_details":
            plans.append(plan_of(df))
        return real(self, name, df, *args, **options)

    monkeypatch.setattr(versions.Build, "write", write)
    tables_of(spark, SF).with_added_month()
    assert "BroadcastHashJoin" in plans[0] and "LeftAnti" in plans[0]
    assert "late_orders" in plans[0]
