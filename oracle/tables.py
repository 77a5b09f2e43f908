"""SQL for the audits, cleaning operators, table construction and files."""

from oracle.model import (
    over_both,
    over_clean_fact,
    over_cleaned,
    over_fact,
    over_raw,
    over_shop,
)

RAW_CUSTOMER_COLUMNS = (
    "customer_id first_name last_name country city email signup_date loyalty_status age"
).split()


def picked(table: str, *columns: str) -> str:
    return over_cleaned(f"select {', '.join(columns)} from {table}")


def profile(column: str, table: str, *percentiles: str) -> str:
    extra = "".join(f", {p}" for p in percentiles)
    return over_raw(f"""
select count(*) as row_count, count({column}) as value_count, {{low}}(min({column})) as minimum,
       {{low}}(max({column})) as maximum,
       cast(sum({column}) as double) / count({column}) as average,
       round(stddev_samp(cast({column} as double)), 6) as deviation{extra}
from {table}""").replace("{low}", "" if column == "age" else "to_double")


def to_double(sql: str) -> str:
    """Extremes of decimals as doubles."""
    return sql.replace("to_double(min(", "(0e0 + min(").replace("to_double(max(", "(0e0 + max(")


DECIMALS = "cast({0} as double) as {0}"
LINE = "order_detail_id, order_id, product_id"
PRICED_LINE = (
    f"{LINE}, quantity, {DECIMALS.format('discount')}, {DECIMALS.format('tax_rate')}, "
    f"{DECIMALS.format('total_price')}, {DECIMALS.format('profit')}"
)
LOAD_CHECK = """
select count(*) as total_rows, cast(min(order_date) as varchar) as earliest_date,
       cast(max(order_date) as varchar) as latest_date,
       cast(sum(revenue) as double) as total_revenue, cast(sum(profit) as double) as total_profit,
       round(100.0::double * sum(profit)::double / sum(revenue)::double, 2) as overall_margin_pct
from """


def orphan_orders(key: str, parent: str, issue: str) -> str:
    return over_raw(f"""
select order_id, {key}, cast(order_date as varchar) as order_date, '{issue}' as issue
from raw_orders o where not exists (select 1 from {parent} p where p.{key} = o.{key})""")


def report(name: str, raw: str, clean: str, *filled: str, kept: str = "") -> str:
    """``kept`` are the raw rows that cleaning keeps, if it removes any."""
    nulls = " + ".join(f"count(*) filter ({c} is null)" for c in filled) or "count(*) filter (false)"
    return f"""
select '{name}' as table_name, a.n as rows_before, b.n as rows_after,
       a.n - b.n as rows_removed, a.gaps as nulls_before, b.gaps as nulls_after,
       k.gaps - b.gaps as filled, cast(0 as bigint) as rejected
from (select count(*) as n, cast({nulls} as bigint) as gaps from {raw}) a,
     (select cast({nulls} as bigint) as gaps from {kept or raw}) k,
     (select count(*) as n, cast({nulls} as bigint) as gaps from {clean}) b"""


AUDITS = {
    "aud01_null_counts": over_raw(
        " union all ".join(
            f"select '{c}' as column_name, count(*) filter ({c} is null) as null_count"
            " from raw_customers"
            for c in RAW_CUSTOMER_COLUMNS
        )
    ),
    "aud02_orders_without_customer": orphan_orders(
        "customer_id", "shop_customers", "Customer does not exist"
    ),
    "aud03_orders_without_region": orphan_orders(
        "region_id", "shop_regions", "Region does not exist"
    ),
    "aud04_lines_without_order": over_raw(f"""
select {LINE}, 'Order does not exist' as issue from raw_lines
where order_id not in (select order_id from raw_orders join shop_customers using (customer_id))"""),
    "aud05_lines_without_product": over_raw(f"""
select {LINE}, 'Product does not exist' as issue from raw_lines
where product_id not in (select product_id from raw_products)"""),
    "aud06_signup_range": over_raw("""
select cast(min(signup_date) as varchar) as earliest_signup,
       cast(max(signup_date) as varchar) as latest_signup from raw_customers"""),
    "aud06_order_range": over_raw("""
select cast(min(order_date) as varchar) as earliest_order,
       cast(max(order_date) as varchar) as latest_order from raw_orders"""),
    "aud07_age_profile": profile(
        "age",
        "raw_customers",
        "cast(sum(age) // count(age) as bigint) as whole_average",
        "quantile_cont(age, 0.25) as q1",
        "quantile_cont(age, 0.5) as median",
        "quantile_cont(age, 0.75) as q3",
    ),
    "aud08_profit_profile": to_double(profile("profit", "raw_lines")),
    "aud09_price_profile": to_double(
        profile(
            "unit_price", "raw_products",
            "round(quantile_cont(cast(unit_price as double), 0.5), 6) as median",
        )
    ),
    "aud10_discount_profile": to_double(
        profile(
            "discount", "raw_lines", "quantile_cont(cast(discount as double), 0.5) as median"
        )
    ),
    "aud11_customers_by_age": over_raw("""
select customer_id, first_name, last_name, country, age from raw_customers
where age is not null"""),
    "aud12_known_profits": over_raw("select count(profit) as total_rows from raw_lines"),
    "aud13_profit_signs": over_raw("""
select n as value_count, below as negative_count, above as positive_count,
       round(100.0::double * below / n, 1) as negative_pct,
       round(100.0::double * above / n, 1) as positive_pct
from (select count(profit) as n, count(*) filter (profit < 0) as below,
             count(*) filter (profit > 0) as above from raw_lines)"""),
    "aud14_extreme_prices": over_raw("""
select product_id, product_name, category, cast(unit_price as double) as unit_price,
       case when unit_price < 1300 then 'Very cheap' else 'Very expensive' end as band
from raw_products where unit_price not between 1300 and 1400"""),
    "aud15_region_ids_around_mapping": over_cleaned("""
select region_id, cast(sum(old) as bigint) as rows_before, cast(sum(new) as bigint) as rows_after
from (select region_id, 1 as old, 0 as new from raw_orders
      union all select region_id, 0, 1 from moved_orders)
group by region_id"""),
    "aud15_ship_modes": over_raw(
        "select ship_mode, count(*) as row_count from raw_orders group by ship_mode"
    ),
    "aud16_shared_emails": over_cleaned("""
select cast(coalesce(sum(n), 0) as bigint) as duplicate_rows, count(*) as shared_keys
from (select count(*) as n from repaired where email is not null group by email having n > 1)"""),
    "aud17_load_check": over_fact(LOAD_CHECK + "fact"),
    "aud18_cleaning_report": over_cleaned(
        " union all ".join(
            (
                report("regions", "raw_regions", "clean_regions"),
                report(
                    "customers", "raw_customers", "clean_customers", "loyalty_status", "age",
                    kept="survivors",
                ),
                report("products", "raw_products", "clean_products", "cost_price"),
                report("orders", "raw_orders", "clean_orders", "delivery_time_days"),
                report(
                    "order_details", "raw_lines", "clean_lines", "discount", "profit",
                    kept="single_lines",
                ),
            )
        )
    ),
    "aud19_calendar_days": over_shop("""
select datediff('day', min(order_date), max(order_date)) + 1 as total_dates
from shop_orders"""),
}

CLEANING = {
    "cln01_repaired_emails": picked("repaired", "customer_id", "email_original", "email"),
    "cln03_customer_survivors": picked("survivors", "customer_id", "email"),
    "cln03_customer_mapping": picked("customer_mapping", "old_customer_id", "new_customer_id"),
    "cln04_orders_repointed": picked("moved_orders", "order_id", "customer_id"),
    "cln05_regions_repointed": picked("moved_orders", "order_id", "region_id"),
    "cln06_loyalty_filled": picked("clean_customers", "customer_id", "loyalty_status"),
    "cln06_discount_filled": picked("clean_lines", LINE, DECIMALS.format("discount")),
    "cln07_age_filled": picked("clean_customers", "customer_id", "country", "age"),
    "cln08_delivery_filled": picked(
        "clean_orders", "order_id", "ship_mode", "delivery_time_days"
    ),
    "cln09_missing_signups": picked(
        "clean_customers", "customer_id", "cast(signup_date as varchar) as signup_date",
        "signup_date_missing",
    ),
    "cln10_costs_imputed": picked(
        "clean_products", "product_id", DECIMALS.format("unit_price"), "cost_price",
        "cost_price_imputed",
    ),
    "cln11_orders_conformed": picked(
        "clean_orders", "order_id", "ship_mode", "payment_method", "order_priority"
    ),
    "cln11_stock_status_conformed": picked("clean_products", "product_id", "stock_status"),
    "cln12_title_case": picked("clean_customers", "customer_id", "country", "city"),
    "cln12_category_title_case": picked(
        "clean_products", "product_id", "category", "subcategory"
    ),
    "cln13_regions": picked("clean_regions", "region_id", "country", "region_name", "manager"),
    "cln13_region_mapping": picked("region_mapping", "old_region_id", "new_region_id"),
    "cln14_lines_once": picked("single_lines", PRICED_LINE),
    "cln15_profit_filled": picked(
        "clean_lines", LINE, "quantity", DECIMALS.format("profit")
    ),
    "cln16_loss_flags": picked("clean_lines", LINE, "is_loss_sale"),
}

FACT_DECIMALS = (
    "discount tax_rate unit_price cost_price revenue cost profit discount_amount gross_amount"
).split()

CONSTRUCTION = {
    "dim01_calendar": over_shop("""
select cast(strftime(d, '%Y%m%d') as integer) as date_key, cast(d as varchar) as full_date,
       cast(year(d) as integer) as "year", strftime(d, '%Y') as year_name,
       cast(quarter(d) as integer) as quarter, 'Q' || quarter(d) as quarter_name,
       cast(month(d) as integer) as "month", monthname(d) as month_name,
       left(monthname(d), 3) as month_name_short, strftime(d, '%B %Y') as month_year,
       cast(strftime(d, '%U') as integer)
         + case when dayofweek(date_trunc('year', d)) = 0 then 0 else 1 end as week_of_year,
       cast(day(d) as integer) as "day", cast(dayofweek(d) + 1 as integer) as day_of_week,
       dayname(d) as day_name, left(dayname(d), 3) as day_name_short,
       dayofweek(d) in (0, 6) as is_weekend, dayofweek(d) not in (0, 6) as is_weekday
from (select cast(unnest(generate_series(min(order_date), max(order_date), interval 1 day))
             as date) as d from shop_orders)"""),
    "fct01_fact_sales": over_fact(
        f"""
select * exclude (order_date, shipping_cents, delivery_time_days, {", ".join(FACT_DECIMALS)}),
       cast(order_date as varchar) as order_date,
       cast(delivery_time_days as double) as delivery_time_days,
       cast(shipping_cents as double) / 100 as shipping_cost,
       {", ".join(DECIMALS.format(c) for c in FACT_DECIMALS)}
from fact"""
    ),
    "fct02_date_parts": over_shop("""
select order_id, cast(order_date as varchar) as order_date,
       cast(year(order_date) as integer) as order_year,
       cast(quarter(order_date) as integer) as order_quarter,
       cast(month(order_date) as integer) as order_month,
       strftime(order_date, '%B') as order_month_name,
       cast(day(order_date) as integer) as order_day,
       strftime(order_date, '%A') as order_day_name
from shop_orders"""),
    "fct03_shipping_allocation": over_fact("""
select order_id, cast(sum(shipping_cents) as double) / 100 as allocated,
       cast(sum(revenue) as double) as revenue
from fact group by order_id"""),
    "fct03_exact_allocation": over_fact("""
select order_id, order_detail_id, product_id, cast(revenue as double) as revenue,
       cast((low + case when place <= amount - given then 1 else 0 end) as double) / 100
         as shipping_cost
from (select *, sum(low) over (partition by order_id) as given,
             row_number() over (partition by order_id
                                order by rest desc, order_detail_id, revenue desc) as place
      from (select *, (amount * part) // whole as low, (amount * part) % whole as rest
            from (select f.order_id, order_detail_id, product_id, revenue,
                         cast(o.shipping_cost * 100 as hugeint) as amount,
                         cast(revenue * 100 as hugeint) as part,
                         sum(cast(revenue * 100 as hugeint)) over (partition by f.order_id) as whole
                  from fact f join shop_orders o on o.order_id = f.order_id)))"""),
    "agg03_customers_by_bitmap": over_fact("""
select 'month' as level, cast(order_year as double) as order_year,
       cast(order_month as double) as order_month, count(distinct customer_id) as customers
from fact group by all
union all
select 'year', order_year, null, count(distinct customer_id) from fact group by all
union all
select 'all', null, null, count(distinct customer_id) from fact"""),
    "agg07_price_sketches": over_raw("""
select category, count(unit_price) as n, true as median_within, true as p95_within
from raw_products group by category"""),
    "jon03_bucketed_products": over_fact("""
select category, supplier, count(*) as lines, cast(sum(revenue) as double) as revenue
from fact f join shop_products p on p.product_id = f.product_id
group by category, supplier"""),
    "cln04_chained_ids": over_shop("""
select customer_id as old_customer_id, customer_id - customer_id % 16 as new_customer_id
from shop_customers where customer_id % 16 <> 0"""),
    "fct06_flag_counts": over_fact("""
select count(*) filter (is_loss_sale) as is_loss_sale,
       count(*) filter (is_discounted) as is_discounted,
       count(*) filter (is_high_value) as is_high_value,
       count(*) filter (is_bulk_order) as is_bulk_order
from fact"""),
    "fct08_country_from_region": over_both(f"""
select {LINE}, f.region_id, coalesce(r.country, 'unknown') as region_country
from fact f left join clean_regions r on r.region_id = f.region_id"""),
    "fct10_full_name": over_fact(f"select {LINE}, customer_id, customer_full_name from fact"),
    "fct11_added_month": over_clean_fact("""
select order_id, order_year, count(*) as lines, cast(sum(revenue) as double) as revenue,
       cast(sum(shipping_cents) as double) / 100 as shipping_cost,
       cast(sum(profit) as double) as profit
from clean_fact group by order_id, order_year"""),
    "fct_from_cleaned": over_clean_fact("""
select order_year, cast(sum(revenue) as double) as total_revenue,
       cast(sum(profit) as double) as total_profit, count(distinct order_id) as order_count,
       cast(sum(revenue) as double) / count(distinct order_id) as avg_order_value
from clean_fact group by order_year"""),
    "fct_from_cleaned_check": over_clean_fact(LOAD_CHECK + "clean_fact"),
}

FILES = {
    "src01_csv_scan": over_raw("""
select cast(order_id as varchar) as order_id, cast(order_date as varchar) as order_date,
       cast(customer_id as varchar) as customer_id, cast(region_id as varchar) as region_id,
       ship_mode, payment_method, cast(delivery_time_days as double) as delivery_time_days,
       cast(shipping_cost as double) as shipping_cost, order_priority
from raw_orders"""),
    "src04_float_written_integers": over_raw("""
select cast(order_id as varchar) as order_id, cast(order_date as varchar) as order_date,
       cast(customer_id as varchar) as customer_id, cast(region_id as varchar) as region_id,
       ship_mode, payment_method, cast(delivery_time_days as double) as delivery_time_days,
       cast(shipping_cost as double) as shipping_cost, order_priority
from raw_orders"""),
    "src05_reordered_header": picked(
        "region_mapping",
        "cast(old_region_id as varchar) as old_region_id",
        "cast(new_region_id as varchar) as new_region_id",
    ),
    "snk03_customers_csv": over_raw("""
select cast(customer_id as varchar) as customer_id, first_name, last_name, country, city, email,
       cast(signup_date as varchar) as signup_date, loyalty_status, cast(age as double) as age
from raw_customers"""),
    "src02_quoted_csv": over_raw(f"""
select cast(product_id as varchar) as product_id, product_name || ', 12"' as product_name,
       category, subcategory, {DECIMALS.format("unit_price")}, {DECIMALS.format("cost_price")},
       supplier, stock_status
from raw_products"""),
    "src06_quoted_line_breaks": over_raw(f"""
select cast(product_id as varchar) as product_id,
       product_name || chr(10) || chr(10) || 'second, "line"' || chr(10) as product_name,
       category, subcategory, {DECIMALS.format("unit_price")}, {DECIMALS.format("cost_price")},
       '"' || supplier || chr(10) || ',' as supplier, stock_status
from raw_products"""),
    "src03_mapping_scan": picked(
        "customer_mapping",
        "cast(old_customer_id as varchar) as old_customer_id",
        "cast(new_customer_id as varchar) as new_customer_id",
    ),
    "snk01_cleaned_products": picked(
        "clean_products",
        "cast(product_id as varchar) as product_id", "product_name", "category", "subcategory",
        DECIMALS.format("unit_price"), "cost_price", "supplier", "stock_status",
        "cost_price_imputed",
    ),
    "snk02_region_mapping": picked(
        "region_mapping",
        "cast(old_region_id as varchar) as old_region_id",
        "cast(new_region_id as varchar) as new_region_id",
    ),
}
