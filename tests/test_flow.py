"""CSV files in, cleaned tables and answers out, as a user would run it."""

from __future__ import annotations

from decimal import Decimal

import pytest

from shelfmark.operators import star
from shelfmark.plans import cleaning, customers, products, profiling, revenue, time_series, warehouse
from shelfmark.plans.questions import QUESTIONS
from shelfmark.sources import schemas, tables

FILES = {
    "regions": """region_id,country,region_name,manager
R1,Spain,Western Europe,Ana Gil
R2,spain,Western EU,ana gil
R3,Italy,Central Europe,Ugo Re
""",
    "customers": """customer_id,first_name,last_name,country,city,email,signup_date,loyalty_status,age
C1,Ann,Bo,spain,madrid,ann@gmail.com,2022-05-01,Gold,30
C2,Ann,Bo,spain,madrid,ANNGMAIL.COM,2021-05-01,,
C3,Cy,Do,italy,rome,,,Silver,50
""",
    "products": '''product_id,product_name,category,subcategory,unit_price,cost_price,supplier,stock_status
P1,"Screen 27""",tech,screens,100.00,60.00,Acme,in stock
P2,"Pen, red",office,pens,10.00,,Acme,LOW STOCK
''',
    "orders": """order_id,order_date,customer_id,region_id,ship_mode,payment_method,delivery_time_days,shipping_cost,order_priority
O1,2023-03-01,C1,R2,express,visa,2,10.00,LOW
O2,2024-03-01,C2,R1,Express,ideal,,5.00,high
O3,2024-04-01,C3,R3,Express,sepa,3,6.00,high
""",
    "order_details": """order_detail_id,order_id,product_id,quantity,discount,tax_rate,total_price,profit
L1,O1,P1,1,0.00,0.21,121.00,40.00
L2,O1,P1,1,0.00,0.21,121.00,40.00
L3,O1,P2,2,,0.21,24.20,
L4,O2,P1,1,0.50,0.21,60.50,-10.00
L5,O3,P2,1,0.10,0.21,10.89,
""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("flow")
    for name, text in FILES.items():
        (path / f"{name}.csv").write_text(text)
    return path


@pytest.fixture(scope="module")
def shop(spark, folder):
    warehouse.build_warehouse(spark, str(folder), str(folder / "target"))
    return warehouse.open_warehouse(spark, str(folder / "target"))


def test_schemas_are_as_declared(shop):
    written = star.with_calendar_parts(shop["dim_date"].select("full_date"))
    assert written.dtypes == shop["dim_date"].dtypes
    assert sorted(shop["fact_sales"].columns) == sorted(star.FACT_COLUMNS)
    assert shop["dim_date"].count() == 398  # 2023-03-01 to 2024-04-01
    assert shop["rejects"].count() == 0


def test_float_written_numbers_unfit_fields_and_other_column_orders(spark, tmp_path):
    files = {k: v.replace(",30\n", ",30.0\n").replace(",2,10.00", ",2.0,10.00") for k, v in FILES.items()}
    files["orders"] = files["orders"].replace("2024-03-01,C2", "2026-01-02,C2")
    files["customers"] = files["customers"].replace("2022-05-01", "May 2022")
    header, *rest = files["regions"].splitlines()
    files["regions"] = "\n".join(
        ",".join([x[2], x[0], x[3], x[1]]) for x in (r.split(",") for r in [header, *rest])
    )
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    warehouse.build_warehouse(spark, str(tmp_path), str(tmp_path / "target"))
    shop = warehouse.open_warehouse(spark, str(tmp_path / "target"))
    assert shop["fact_sales"].count() == 4
    assert {r.region_name for r in shop["regions"].collect()} == {"Western Europe", "Central Europe"}
    assert [tuple(r) for r in shop["rejects"].collect()] == [("customers", "signup_date", "May 2022")]
    assert {r.age for r in shop["customers"].collect()} >= {50.0}
    months = warehouse.ask_all(shop)["q47_same_month_last_year"].collect()
    assert {(r.year, r.month) for r in months} == {(2023, 3), (2024, 4), (2026, 1)}


def test_rules_of_the_cleaning_are_parameters(spark, folder):
    raw = {name: tables.load_raw(spark, str(folder), name) for name in schemas.RAW}
    rules = cleaning.Rules(
        stock_statuses={"LOW STOCK": "Scarce"}, ship_modes={"express": "Fast"},
        unknown_loyalty="None", cost_share=0.5,
    )
    done = warehouse.clean_all(raw, rules)
    assert {r.stock_status for r in done["products"].collect()} == {"in stock", "Scarce"}
    assert {r.product_id: r.cost_price for r in done["products"].collect()}["P2"] == 5.0
    assert {r.ship_mode for r in done["orders"].collect()} == {"Fast", "Express"}
    assert {r.loyalty_status for r in done["customers"].collect()} == {"None", "Silver"}


def test_mappings_are_written(shop):
    assert [tuple(r) for r in shop["customer_id_mapping"].collect()] == [("C1", "C2")]
    assert [tuple(r) for r in shop["region_id_mapping"].collect()] == [("R2", "R1")]


def test_from_files_to_answers(shop):
    fact = shop["fact_sales"]
    years = {r.order_year: r for r in revenue.by_year(fact).collect()}
    assert years[2023].total_revenue == Decimal("145.20")  # the doubled line counts once
    assert years[2023].total_profit == Decimal("46.00")  # 40 + (2 * 10 - 2 * 7)
    assert years[2024].total_profit == Decimal("-8.00")  # -10 + (1 * 10 * 0.9 - 7)
    assert years[2024].order_count == 2
    orders_of = {r.customer_id: r.order_count for r in customers.order_counts(fact).collect()}
    assert orders_of == {"C2": 2, "C3": 1}  # C1 was merged into C2
    places = {(r.region_id, r.region_country) for r in fact.collect()}
    assert places == {("R1", "Spain"), ("R3", "Italy")}
    assert {r.delivery_time_days for r in fact.collect()} == {2, 3}  # 2.5 filled, cut to whole
    low = products.restock_list(fact, shop["products"], "Low Stock").collect()
    assert [(r.product_name, r.times_sold, r.total_quantity) for r in low] == [("Pen, red", 2, 3)]
    months = time_series.same_month_last_year(fact, shop["dim_date"]).collect()
    assert [(r.year, r.month, r.same_month_last_year) for r in months] == [
        (2023, 3, None), (2024, 3, Decimal("145.20")), (2024, 4, None),
    ]


def test_every_question_runs_with_the_original_parameters(shop):
    answers = warehouse.ask_all(shop)
    assert len(QUESTIONS) == 57 and answers.keys() == QUESTIONS.keys()
    for df in answers.values():
        df.collect()
    assert answers["q01_revenue_by_year"].count() == 2
    assert answers["q28_lines_of_product"].count() == 0
    status = {r.customer_status: r.customer_count for r in answers["q20_churn"].collect()}
    assert status == {"Churned (180+ days)": 2}
    assert answers["q36_on_time"].first().on_time_express == 3


def test_profile_of_the_raw_files(spark, folder):
    raw = {name: tables.load_raw(spark, str(folder), name) for name in schemas.RAW}
    found = {name: df.collect() for name, df in profiling.profile_raw(raw).items()}
    assert found["orders_without_customer"] == found["lines_without_product"] == []
    assert tuple(found["profit_signs"][0]) == (3, 1, 2, 33.3, 66.7)
    assert tuple(found["shared_emails"][0]) == (2, 1)
    assert [(r.product_id, r.band) for r in found["extreme_prices"]] == []
    assert found["prices"][0].median == 55.0
    assert {r.column_name: r.null_count for r in found["nulls_order_details"]}["profit"] == 2
