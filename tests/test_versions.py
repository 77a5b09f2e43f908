"""Warehouses that change all at once, and sales added to them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import warehouse
from shelfmark.sources import versions
from tests.test_flow import FILES


@pytest.fixture(scope="module")
def raw_folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_build_broken_off_leaves_the_old_tables(spark, raw_folder, tmp_path, monkeypatch):
    target = str(tmp_path / "shop")
    with pytest.raises(FileNotFoundError):
        warehouse.open_warehouse(spark, target)
    warehouse.build_warehouse(spark, raw_folder, target)
    before = {name: rows(df) for name, df in warehouse.open_warehouse(spark, target).items()}
    real = warehouse.build_fact_sales

    def broken(*tables, **options):
        return real(*tables, **options).withColumn("revenue", F.raise_error(F.lit("stopped")).cast("decimal(10,2)"))

    monkeypatch.setattr(warehouse, "build_fact_sales", broken)
    with pytest.raises(Exception, match="stopped"):
        warehouse.build_warehouse(spark, raw_folder, target)
    after = {name: rows(df) for name, df in warehouse.open_warehouse(spark, target).items()}
    assert after == before and versions.current(spark, target).number == 1
    monkeypatch.undo()
    warehouse.build_warehouse(spark, raw_folder, target, bulk_quantity=1)
    assert versions.current(spark, target).number == 2
    assert warehouse.open_warehouse(spark, target)["fact_sales"].filter("is_bulk_order").count() == 1
    gone = versions.vacuum(spark, target, keep=1)
    assert gone and versions.vacuum(spark, target, keep=1) == []
    assert len(list((tmp_path / "shop").glob("*/build=*"))) == len(versions.current(spark, target).tables) - 1
    assert warehouse.open_warehouse(spark, target)["fact_sales"].count() == 4


def test_a_reader_keeps_its_tables_while_a_new_build_is_published(spark, raw_folder, tmp_path):
    target = str(tmp_path / "shop")
    warehouse.build_warehouse(spark, raw_folder, target)
    opened = warehouse.open_warehouse(spark, target)["fact_sales"]
    warehouse.build_warehouse(spark, raw_folder, target)
    assert opened.count() == 4


def test_two_builds_on_one_manifest_conflict(spark, tmp_path):
    one, two = (versions.Build(spark, str(tmp_path / "w")) for _ in range(2))
    for build in (one, two):
        build.write("t", spark.range(3))
    one.publish()
    with pytest.raises(versions.Conflict):
        two.publish()
    now = versions.current(spark, str(tmp_path / "w"))
    assert now.number == 1 and now.tables == one.tables


def test_parts_and_empty_tables(spark, tmp_path):
    target = str(tmp_path / "w")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    build = versions.Build(spark, target)
    build.write("t", df, cut_by="k")
    build.write("none", df.limit(0), cut_by="k")
    first = build.publish()
    build = versions.Build(spark, target)
    build.replace("t", spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string"), [2])
    second = build.publish()
    assert first.tables["t"].folders[0] in second.tables["t"].folders
    read = versions.read(spark, target, "t", second.tables["t"])
    assert sorted(map(tuple, read.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, versions.read(spark, target, "t", first.tables["t"]).collect())) == [
        (1, "a"), (2, "b"), (2, "c"),
    ]
    plan = read.filter("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan
    none = versions.read(spark, target, "none", second.tables["none"])
    assert none.dtypes == df.dtypes and none.count() == 0
    build = versions.Build(spark, target)
    build.replace("t", df.limit(0), [1, 2, 3])
    assert build.read("t").count() == 0


def order(order_id, day, customer="C3", region="R3"):
    return (order_id, day, customer, region, "Express", "SEPA", 3.0, 6, "High")


def line(line_id, order_id, quantity=1, product="P2", revenue=10.89):
    return (line_id, order_id, product, quantity, 0.1, 0.21, revenue, 2.0, False)


def test_added_sales_touch_their_years_only(spark, raw_folder, tmp_path):
    target = str(tmp_path / "shop")
    warehouse.build_warehouse(spark, raw_folder, target)
    old = versions.current(spark, target)
    opened = warehouse.open_warehouse(spark, target)

    def like(name, rows):
        return spark.createDataFrame(rows, ", ".join(
            f"{f.name} {'string' if f.dataType.simpleString() == 'date' else 'double' if 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}"
            for f in opened[name].schema
        )).select(*(F.col(f.name).cast(f.dataType) for f in opened[name].schema))

    # a new order with a doubled line, a line for an order of 2024, a moved order of 2024
    new_orders = [order("O9", "2025-06-01"), order("O3", "2023-05-05")]
    new_lines = [line("L9", "O9"), line("L90", "O9"), line("L91", "O9", 2), line("L92", "O2", 3)]
    new_orders = [tuple(float(x) if isinstance(x, int) else x for x in o) for o in new_orders]
    orders_, lines_ = like("orders", new_orders), like("order_details", new_lines)
    now = warehouse.add_sales(spark, target, orders_, lines_)
    added = warehouse.open_warehouse(spark, target)
    fact = added["fact_sales"]
    assert {(r.order_id, r.order_detail_id, r.order_year) for r in fact.collect()} == {
        ("O1", "L1", 2023), ("O1", "L3", 2023), ("O2", "L4", 2024), ("O2", "L92", 2024),
        ("O3", "L5", 2023), ("O9", "L9", 2025), ("O9", "L91", 2025),
    }
    whole = warehouse.build_fact_sales(
        added["order_details"], added["orders"], added["customers"], added["products"], added["regions"]
    )
    assert rows(whole) == rows(fact)
    assert added["dim_date"].agg(F.max("full_date")).first()[0].isoformat() == "2025-06-01"
    assert added["orders"].count() == 4 and added["order_details"].count() == 7
    assert now.tables["customers"] == old.tables["customers"]
    # then only a year that was not there: no other folder changes
    later = like("orders", [tuple(float(x) if isinstance(x, int) else x for x in order("O10", "2026-01-01"))])
    last = warehouse.add_sales(spark, target, later, like("order_details", [line("L99", "O10")]))
    kept = set(now.tables["fact_sales"].folders)
    assert kept < set(last.tables["fact_sales"].folders)
    assert len(last.tables["fact_sales"].folders) == len(kept) + 1
    assert set(now.tables["orders"].folders) < set(last.tables["orders"].folders)
    assert warehouse.open_warehouse(spark, target)["fact_sales"].count() == 8


def test_the_report_of_a_build(spark, raw_folder, tmp_path):
    target = str(tmp_path / "shop")
    warehouse.build_warehouse(spark, raw_folder, target)
    told = warehouse.open_warehouse(spark, target)["cleaning_report"].collect()
    assert {r.table_name: (r.rows_before, r.rows_after, r.filled, r.rejected) for r in told} == {
        "regions": (3, 2, 0, 0), "customers": (3, 2, 1, 0), "products": (2, 2, 1, 0),
        "orders": (3, 3, 1, 0), "order_details": (5, 4, 3, 0),
    }
