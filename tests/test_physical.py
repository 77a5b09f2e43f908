"""What the plans of all registered queries must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import QUESTIONS, answer, tables_of
from shelfmark.operators import clean, star
from shelfmark.plans import cleaning, customers, products, revenue
from shelfmark.sources.tables import write_fact

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUESTIONS)
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(answer(name, spark, SF))
    assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", QUESTIONS)
def test_single_task_windows_only_see_aggregates(spark, name):
    """A window without partition must read grouped rows, not a scan."""
    lines = plan_of(answer(name, spark, SF)).splitlines()
    depth = [len(re.match(r"[\s:+*-]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line or not any(
            "Window" in above for above in lines[max(0, i - 3) : i]
        ):
            continue
        below = []
        for j in range(i + 1, len(lines)):
            if depth[j] <= depth[i]:
                break
            below.append(lines[j])
        first = next(b for b in below if re.search(r"Aggregate|Scan|TakeOrdered|Limit", b))
        assert "Scan" not in first, f"{name}: {first}"


def test_scans_read_only_the_columns_asked_for(spark):
    fact = tables_of(spark, SF).shop.fact
    plan = plan_of(revenue.margin_by_category(fact))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",") if ":" in c} == {
        "revenue", "profit", "product_category",
    }


def test_filters_reach_the_scan(spark):
    shop = tables_of(spark, SF).shop
    assert "LessThan(profit" in plan_of(products.loss_lines(shop.fact))
    assert "EqualTo(product_id,137)" in plan_of(
        products.lines_of_product(shop.fact, shop.products, 137)
    )
    year = plan_of(shop.fact.filter("order_year = 1998").select("revenue"))
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", year)


def test_top_products_take_ordered(spark):
    shop = tables_of(spark, SF).shop
    assert "TakeOrderedAndProject" in plan_of(products.extreme_products(shop.fact, shop.products))


def test_copies_are_cut_before_the_shuffle(spark):
    raw = tables_of(spark, SF).raw
    plan = plan_of(cleaning.drop_duplicate_lines(raw.order_details))
    assert re.search(r"WindowGroupLimit .* Final.*WindowGroupLimit .* Partial", plan, re.S)


def test_primaries_are_aggregated_before_the_shuffle(spark):
    raw = tables_of(spark, SF).raw
    census = clean.repair_emails(raw.customers).groupBy("email").count()
    assert "partial_count" in plan_of(census)


def test_quintiles_shuffle_customers_once(spark):
    """What follows the written slices only shuffles one row of each slice."""
    plan = plan_of(customers.value_tiles(tables_of(spark, SF).shop.fact))
    exchanges = re.findall(r"Exchange (hash|range)partitioning\(([^,)]*)", plan)
    assert len(exchanges) == 1
    assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial_count", plan)


def test_orders_shuffle_once_by_each_key(spark):
    shop = tables_of(spark, SF).shop
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        plan = plan_of(star.order_side(shop.summed_orders, shop.buyers, shop.regions))
    finally:
        spark.conf.set(threshold, before)
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(keys) == sorted(["order_id", "l_orderkey", *["customer_id", "region_id"] * 2])
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"FileScan parquet \[c_", plan)) == 1


def test_files_of_the_fact_do_not_follow_the_tasks(spark, tmp_path):
    sales = spark.range(0, 40_000, 1, 64).withColumn("order_year", F.col("id") % 3 + 2020)
    write_fact(sales, str(tmp_path / "fact"))
    files = list((tmp_path / "fact").glob("order_year=*/*.parquet"))
    assert {f.parent.name for f in files} == {f"order_year={y}" for y in (2020, 2021, 2022)}
    assert len(files) <= 8
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 40_000
