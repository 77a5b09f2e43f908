"""Readers, writers and the shared folder."""

from __future__ import annotations

from decimal import Decimal

import pytest

from shelfmark import catalog
from shelfmark.sources import schemas, shared, tables


def test_csv_quotes_and_types(spark, tmp_path):
    (tmp_path / "products.csv").write_text(
        "product_id,product_name,category,subcategory,unit_price,cost_price,supplier,stock_status\n"
        'P1,"Screen 27"" wide, black",Tech,Screens,10.50,,Acme,in stock\n'
    )
    row = tables.load_raw(spark, str(tmp_path), "products").first()
    assert row.product_name == 'Screen 27" wide, black'
    assert (row.unit_price, row.cost_price) == (Decimal("10.50"), None)


def test_every_row_is_loaded_and_unfit_fields_are_told(spark, tmp_path):
    path = tmp_path / "mapping.csv"
    path.write_text("new_id,old_id,more\n2,1,a\n3,x,b\n4.0,5.5,c\n6,7,d,e\n")
    rows, rejects = tables.load_csv(spark, str(path), "old_id int, new_id int")
    assert [tuple(r) for r in rows.collect()] == [(1, 2), (None, 3), (None, 4), (7, 6)]
    assert sorted(map(tuple, rejects.collect())) == [
        ("corrupt_record", "6,7,d,e"), ("old_id", "5.5"), ("old_id", "x"),
    ]


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "m.csv").write_text("old_id\n1\n")
    with pytest.raises(ValueError, match="new_id"):
        tables.load_csv(spark, str(tmp_path / "m.csv"), "old_id int, new_id int")


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 'q"uo,te'), ("b", None), (" lead trail ", "two\nlines"), ("c", "")]
    df = spark.createDataFrame(rows, schemas.CUSTOMER_MAPPING)
    tables.write_mapping(df, str(tmp_path / "m"))
    back = tables.load_mapping(spark, str(tmp_path / "m"), schemas.CUSTOMER_MAPPING)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_every_schema_parses():
    for ddl in (*schemas.RAW.values(), *schemas.CLEANED.values()):
        assert len(schemas.struct(ddl)) >= 2


class Session:
    """Only the settings of a session."""

    def __init__(self, **settings):
        self.conf = {f"spark.{key.replace('_', '.')}": value for key, value in settings.items()}


def test_shared_folder_is_the_named_one():
    named = Session(master="yarn", checkpoint_dir="hdfs://shared/checkpoints/", app_id="app-1")
    assert shared.shared_folder(named) == "hdfs://shared/checkpoints"
    first, second = (shared.new_table_path(named, "x") for _ in range(2))
    assert first.startswith("hdfs://shared/checkpoints/shelfmark/app-1/x-") and first != second


def test_a_local_session_may_do_without():
    assert shared.shared_folder(Session(master="local[2]"))


def test_a_cluster_without_shared_folder_is_refused():
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_folder(Session(master=master))


def test_settled_table_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(id as decimal(10,2)) as m", "date'2024-01-01' as d")
    again = shared.settle(df, "t")
    assert again.dtypes == df.dtypes and again.exceptAll(df).count() == 0
    assert "Range" not in again._jdf.queryExecution().executedPlan().toString()


def test_tables_are_opened_anew_when_their_files_change(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = catalog.tables_of(spark, str(tmp_path))
    assert catalog.tables_of(spark, str(tmp_path)) is first
    rows = first.shop.regions.count()
    few = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").filter("n_nationkey < 5")
    few.write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    again = catalog.tables_of(spark, str(tmp_path))
    assert rows == 25 and again is not first and again.shop.regions.count() == 5
