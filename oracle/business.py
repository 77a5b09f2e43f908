"""SQL for the business questions."""

from oracle.model import over_fact, over_shop

MARGIN = "round(100.0::double * sum(profit)::double / nullif(sum(revenue), 0)::double, 2)"


def money(column: str, name: str | None = None) -> str:
    return f"cast(sum({column}) as double) as {name or 'total_' + column}"


def mean(column: str) -> str:
    return f"cast(sum({column}) as double) / count({column})"


SHIPPING = "cast(cast(sum(shipping_cents) as decimal(38,0)) as double) / 100"


def growth(now: str, before: str) -> str:
    return f"100.0::double * ({now}::double - {before}::double) / nullif({before}, 0)::double"


def sums(*keys: str) -> str:
    listed = ", ".join(keys)
    return over_fact(
        f"select {listed}, {money('revenue')}, {money('profit')} from fact group by {listed}"
    )


def margins(*keys: str) -> str:
    listed = ", ".join(keys)
    return over_fact(
        f"select {listed}, {money('profit')}, {money('revenue')}, {MARGIN} as profit_margin_pct"
        f" from fact group by {listed}"
    )


def top(count: int, direction: str) -> str:
    return over_fact(f"""
select product_id, any_value(product_category) as product_category,
       any_value(product_supplier) as product_supplier, {money("profit")},
       cast(row_number() over (order by sum(profit) {direction}, product_id) as integer)
         as profit_rank,
       any_value(p.product_name) as product_name
from fact join shop_products p using (product_id) group by product_id
order by profit_rank limit {count}""")


def products_by(column: str, name: str, kind: str) -> str:
    return over_fact(f"""
select product_id, product_category, product_name, cast(sum({column}) as {kind}) as {name}
from fact join shop_products using (product_id)
group by product_id, product_category, product_name""")


def restock(status: str) -> str:
    return over_fact(f"""
select p.product_id, product_name, stock_status, {money("revenue")},
       count(*) as times_sold, cast(sum(quantity) as bigint) as total_quantity
from fact f join shop_products p on p.product_id = f.product_id and stock_status = '{status}'
group by p.product_id, product_name, stock_status""")


def delivery(key: str) -> str:
    return over_fact(f"""
select {key}, {mean("delivery_time_days")} as avg_delivery_days,
       cast(sum(delivery_time_days) // count(delivery_time_days) as bigint) as whole_delivery_days
from fact group by {key}""")


def tile(order: str) -> str:
    return f"cast(ntile(5) over (order by {order}, customer_id) as integer)"


COUNTRIES = [f"NATION_{i}" for i in range(25)]
LIMITS = {"Overnight": 500, "Express": 1000, "Standard": 1500, "Economy": 2000}

BUSINESS = {
    "q01_revenue_by_year": over_fact(f"""
select order_year, {money("revenue")}, {money("profit")},
       count(distinct order_id) as order_count,
       cast(sum(revenue) as double) / count(distinct order_id) as avg_order_value
from fact group by order_year"""),
    "q02_revenue_by_quarter": sums("order_year", "order_quarter"),
    "q03_revenue_by_month": sums("order_year", "order_month"),
    "q04_margin_by_category": margins("product_category"),
    "q05_margin_by_product": over_fact(f"""
select product_id, product_category, product_name, {money("profit")}, {money("revenue")},
       {MARGIN} as profit_margin_pct
from fact join shop_products using (product_id)
group by product_id, product_category, product_name"""),
    "q06_margin_by_country": margins("region_id", "region_country"),
    "q07_top_products": top(10, "desc"),
    "q08_bottom_products": top(10, "asc"),
    "q09_yearly_growth": over_fact(f"""
select order_year, cast(now as double) as current_revenue, cast(before as double)
         as previous_revenue, round({growth("now", "before")}, 2) as growth_pct
from (select order_year, now, lag(now) over (order by order_year) as before
      from (select order_year, sum(revenue) as now from fact group by order_year))"""),
    "q10_signups_by_month": over_shop("""
select cast(year(signup_date) as double) as signup_year,
       cast(month(signup_date) as double) as signup_month,
       count(distinct customer_id) as new_customers
from shop_customers group by all"""),
    "q11_orders_per_customer": over_fact("""
select customer_id, count(distinct order_id) as order_count from fact group by customer_id"""),
    "q12_repeat_rate": over_fact("""
select cast(count(*) filter (n > 1) as double) / count(*) as repeat_rate,
       count(*) filter (n > 1) as repeat_customers, count(*) as total_customers
from (select count(distinct order_id) as n from fact group by customer_id)"""),
    "q15_value_quintiles": over_fact(f"""
select value_tile, count(*) as customer_count, {mean("worth")} as avg_value,
       cast(min(worth) as double) as min_value, cast(max(worth) as double) as max_value,
       {money("worth", "tile_revenue")},
       100.0::double * sum(worth)::double / (select sum(revenue)::double from fact)
         as pct_of_revenue
from (select worth, {tile("worth desc")} as value_tile
      from (select customer_id, sum(revenue) as worth from fact group by customer_id))
group by value_tile"""),
    "q16_loyalty_averages": over_fact(f"""
select customer_loyalty_status, {mean("revenue")} as avg_revenue, {mean("profit")} as avg_profit
from fact group by customer_loyalty_status"""),
    "q17_customers_by_country": over_shop(
        "select count(*) as total_customers, "
        + ", ".join(f"count(*) filter (country = '{c}') as count_{c.lower()}" for c in COUNTRIES)
        + " from shop_customers"
    ),
    "q18_customer_shares": over_shop(
        "select "
        + ", ".join(
            f"round(100.0::double * count(*) filter (country = '{c}') / count(*), 2)"
            f" as pct_{c.lower()}"
            for c in COUNTRIES
        )
        + " from shop_customers"
    ),
    "q19_discount_effect": over_fact(f"""
select case when discount = 0 then 'No Discount' when discount <= 0.03 then '1-3%'
            when discount <= 0.07 then '4-7%' when discount <= 0.10 then '8-10%' end
         as discount_range,
       count(*) as line_count, {mean("quantity")} as avg_quantity,
       cast(sum(quantity) // count(quantity) as bigint) as whole_quantity,
       {mean("revenue")} as avg_revenue, {MARGIN} as profit_margin_pct
from fact where discount >= 0 group by discount_range"""),
    "q20_churn": over_fact("""
select case when gap <= 30 then 'Active (0-30 days)' when gap <= 90 then 'Recent (30-90 days)'
            when gap <= 180 then 'At Risk (90-180 days)' else 'Churned (180+ days)' end
         as customer_status,
       count(*) as customer_count,
       100.0::double * count(*) / (select count(distinct customer_id) from fact) as pct_customers
from (select datediff('day', max(order_date), (select max(order_date) from fact)) as gap
      from fact group by customer_id)
group by customer_status"""),
    "q21_products_by_revenue": products_by("revenue", "total_revenue", "double"),
    "q22_products_by_quantity": products_by("quantity", "total_quantity", "bigint"),
    "q23_products_by_profit": products_by("profit", "total_profit", "double"),
    "q24_categories": over_fact(f"""
select product_category, cast(sum(quantity) as bigint) as total_quantity, {money("revenue")},
       {money("profit")}, {MARGIN} as profit_margin_pct
from fact group by product_category"""),
    "q25_cross_selling": over_fact("""
select n as categories_per_order, count(*) as order_count,
       100.0::double * count(*) / (select count(distinct order_id) from fact) as pct_of_orders
from (select count(distinct product_category) as n from fact group by order_id) group by n"""),
    "q26_loss_lines": over_fact("""
select product_id, order_id, order_detail_id, cast(revenue as double) as revenue,
       cast(cost as double) as cost, cast(profit as double) as profit,
       cast(discount as double) as discount, cast(discount_amount as double) as discount_amount
from fact where is_loss_sale"""),
    "q27_loss_summary": over_fact(f"""
select count(*) as loss_lines, {money("profit", "total_losses")},
       count(distinct product_id) as products_with_losses,
       count(distinct order_id) as orders_with_losses
from fact where is_loss_sale"""),
    "q28_lines_of_product": over_fact("""
select product_id, order_id, order_detail_id, product_category, product_name,
       cast(profit as double) as profit
from fact join shop_products using (product_id) where product_id = 137"""),
    "q29_lines_by_profit": over_fact("""
select product_id, product_category, cast(profit as double) as profit, order_id, order_detail_id
from fact"""),
    "q30_revenue_by_stock_status": over_fact(f"""
select stock_status, {money("revenue")}
from fact join shop_products using (product_id) group by stock_status"""),
    "q31_stock_status_shares": over_fact(f"""
select stock_status, {money("revenue")},
       round(100.0::double * sum(revenue)::double / (select sum(revenue)::double from fact), 2)
         as pct_of_revenue
from fact join shop_products using (product_id) group by stock_status"""),
    "q32_low_stock": restock("Low Stock"),
    "q33_out_of_stock_share": over_fact("""
select 100.0::double * (sum(revenue) filter (stock_status = 'Out of Stock'))::double
         / (select sum(revenue)::double from fact) as pct_of_revenue
from fact join shop_products using (product_id)"""),
    "q34_out_of_stock": restock("Out of Stock"),
    "q35_delivery_by_ship_mode": delivery("ship_mode"),
    "q36_on_time": over_shop(
        "select "
        + ", ".join(
            f"count(*) filter (ship_mode = '{m}') as {m.lower()}_deliveries, "
            f"count(*) filter (ship_mode = '{m}' and delivery_time_days <= {days})"
            f" as on_time_{m.lower()}"
            for m, days in LIMITS.items()
        )
        + " from shop_orders"
    ),
    "q37_shipping_share_by_order": over_fact(f"""
select order_id, {money("gross_amount", "order_value")}, {SHIPPING} as order_shipping_cost,
       round(100.0::double * ({SHIPPING}) / sum(gross_amount)::double, 2) as shipping_pct
from fact group by order_id"""),
    "q38_shipping_share": over_fact(f"""
select {SHIPPING} as total_shipping_cost, {money("gross_amount", "total_order_value")},
       round(100.0::double * ({SHIPPING}) / sum(gross_amount)::double, 2) as shipping_pct
from fact"""),
    "q39_delivery_by_priority": delivery("order_priority"),
    "q40_revenue_by_country": over_fact(f"""
select region_id, region_country, {money("revenue", "country_revenue")} from fact group by all"""),
    "q41_country_shares": over_fact(f"""
select region_id, region_country, {money("revenue", "country_revenue")},
       round(100.0::double * sum(revenue)::double / (select sum(revenue)::double from fact), 2)
         as country_share_pct
from fact group by region_id, region_country"""),
    "q42_country_growth": over_fact(f"""
select region_id, region_country, order_year, cast(now as double) as current_revenue,
       cast(before as double) as previous_revenue,
       round({growth("now", "before")}, 2) as growth_pct
from (select *, lag(now) over (partition by region_id order by order_year) as before
      from (select region_id, region_country, order_year, sum(revenue) as now
            from fact group by all))"""),
    "q43_country_margins": margins("region_id", "region_country", "order_year"),
    "q44_manager_margins": margins(
        "region_manager", "region_id", "region_country", "order_year"
    ),
    "q45_moving_average": over_fact("""
select order_year, order_month, order_month_name, cast(now as double) as monthly_revenue,
       cast(sum(now) over recent as double) / count(now) over recent as moving_avg
from (select order_year, order_month, order_month_name, sum(revenue) as now
      from fact group by all)
window recent as (order by order_year, order_month rows between 2 preceding and current row)"""),
    "q46_complete_quarters": over_fact(f"""
select order_year, order_quarter, {money("revenue", "quarterly_revenue")},
       count(distinct order_month) as months_in_quarter
from fact where order_year <> 2001 or order_quarter <> 3
group by order_year, order_quarter"""),
    "q47_same_month_last_year": over_fact("""
select order_year as "year", order_month as "month", order_month_name as month_name,
       cast(now as double) as revenue,
       cast(lag(now) over (partition by order_month order by order_year) as double)
         as same_month_last_year
from (select order_year, order_month, order_month_name, sum(revenue) as now
      from fact group by all)"""),
    "q48_avg_monthly_growth": over_fact(f"""
select round(avg({growth("now", "before")}), 6) as avg_monthly_growth_pct
from (select now, lag(now) over (order by order_year, order_month) as before
      from (select order_year, order_month, sum(revenue) as now from fact group by all))"""),
    "q49_avg_quarterly_growth": over_fact(f"""
select round(avg(round({growth("now", "before")}, 2)), 6) as avg_quarterly_growth_pct
from (select now, lag(now) over (order by order_year, order_quarter) as before
      from (select order_year, order_quarter, sum(revenue) as now from fact group by all))"""),
    "r01_payment_methods": over_fact(f"""
select payment_method, count(distinct order_id) as order_count, {money("revenue")},
       round(100.0::double * sum(revenue)::double / (select sum(revenue)::double from fact), 2)
         as pct_of_revenue
from fact group by payment_method"""),
    "r02_revenue_tree": over_fact(f"""
select region_name, region_country, product_category,
       cast(grouping(region_name, region_country, product_category) as integer) as level,
       {money("revenue")}
from fact group by rollup (region_name, region_country, product_category)"""),
    "r03_top_five": top(5, "desc"),
    "r03_bottom_five": top(5, "asc"),
    "r03_stock_alerts": over_fact(f"""
select p.product_id, product_name, stock_status, {money("revenue")},
       cast(sum(quantity) as bigint) as total_quantity
from fact f join shop_products p on p.product_id = f.product_id and stock_status <> 'In Stock'
group by p.product_id, product_name, stock_status"""),
    "r04_shipping_by_mode": over_fact(f"""
select ship_mode, count(distinct order_id) as order_count, {SHIPPING} as total_shipping_cost,
       ({SHIPPING}) / count(*) as avg_line_shipping_cost,
       round(100.0::double * ({SHIPPING}) / sum(gross_amount)::double, 2) as shipping_pct
from fact group by ship_mode"""),
    "r05_rfm": over_fact(f"""
select customer_id, recency_days, frequency, cast(worth as double) as monetary,
       {tile("recency_days")} as recency_tile, {tile("frequency desc")} as frequency_tile,
       {tile("worth desc")} as monetary_tile
from (select customer_id, count(distinct order_id) as frequency, sum(revenue) as worth,
             cast(datediff('day', max(order_date), (select max(order_date) from fact)) as integer)
               as recency_days
      from fact group by customer_id)"""),
    "r06_cohorts": over_fact("""
select cast(first_month // 12 as integer) as cohort_year,
       cast(first_month % 12 + 1 as integer) as cohort_month,
       cast(month_no - first_month as integer) as months_since, count(*) as active_customers
from (select month_no, min(month_no) over (partition by customer_id) as first_month
      from (select distinct customer_id, order_year * 12 + order_month - 1 as month_no from fact))
group by all"""),
}
LIFETIME = over_fact(f"""
select customer_id, customer_full_name, {money("revenue", "lifetime_revenue")},
       {money("profit", "lifetime_profit")}
from fact group by customer_id, customer_full_name""")
BUSINESS["q13_lifetime_revenue"] = LIFETIME
BUSINESS["q14_lifetime_profit"] = LIFETIME

#: Ordered lists with their positions, and the keys of their order.
RANKED = {
    "q11_orders_per_customer": "order_count desc, customer_id",
    "q13_lifetime_revenue": "lifetime_revenue desc, lifetime_profit desc, customer_id",
    "q14_lifetime_profit": "lifetime_profit desc, lifetime_revenue desc, customer_id",
    "q21_products_by_revenue": "total_revenue desc, product_id",
    "q22_products_by_quantity": "total_quantity desc, product_id",
    "q23_products_by_profit": "total_profit desc, product_id",
    "q32_low_stock": "total_revenue desc, product_id",
    "q34_out_of_stock": "total_revenue desc, product_id",
    "q37_shipping_share_by_order": "shipping_pct desc nulls last, order_id",
}
BUSINESS |= {
    f"srt01_{name}": f"select *, row_number() over (order by {order}) as position from ({BUSINESS[name]})"
    for name, order in RANKED.items()
}
