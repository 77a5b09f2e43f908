"""The retail model as SQL over the given tables, for the correctness check.

Money is DECIMAL(10,2). Where a quotient has to be rounded per line, it is
rounded half up in whole cents, so that both engines agree on exact ties.
"""

CLEAN = """
shop_regions as (
  select n_nationkey as region_id, n_name as country, r_name as region_name, r_name as manager
  from nation join region on n_regionkey = r_regionkey),
signups as (
  select user_id, cast(min(ts) as date) as signup_date
  from events where event_type = 'signup' group by user_id),
shop_customers as (
  select c_custkey as customer_id, split_part(c_name, '#', 1) as first_name,
         split_part(c_name, '#', 2) as last_name, n_name as country,
         lower(replace(n_name, '_', '-')) as city, lower(c_name) || '@gmail.com' as email,
         signup_date, c_mktsegment as loyalty_status,
         cast((floor(c_acctbal) % 48 + 48) % 48 + 23 as integer) as age
  from customer left join nation on c_nationkey = n_nationkey
  left join signups on user_id = c_custkey),
shop_products as (
  select p_partkey as product_id, p_name as product_name, p_type as category,
         p_brand as subcategory,
         cast(round(p_retailprice / 0.70::double, 2) as decimal(10,2)) as unit_price,
         cast(p_retailprice as decimal(10,2)) as cost_price,
         'Supplier of ' || p_brand as supplier,
         case when p_size <= 10 then 'Out of Stock' when p_size <= 30 then 'Low Stock'
              else 'In Stock' end as stock_status
  from part),
deliveries as (
  select l_orderkey, cast(max(l_shipdate) as date) as delivered from lineitem group by l_orderkey),
shop_orders as (
  select o_orderkey as order_id, cast(o_orderdate as date) as order_date,
         o_custkey as customer_id, c_nationkey as region_id,
         case left(o_orderpriority, 1) when '1' then 'Overnight' when '2' then 'Express'
              when '5' then 'Economy' else 'Standard' end as ship_mode,
         case o_orderstatus when 'F' then 'Visa' when 'O' then 'Mastercard'
              when 'P' then 'PayPal' end as payment_method,
         case when datediff('day', cast(o_orderdate as date), delivered) >= 0
              then cast(datediff('day', cast(o_orderdate as date), delivered) as integer)
              end as delivery_time_days,
         cast(o_totalprice as decimal(10,2)) as shipping_cost,
         case left(o_orderpriority, 1) when '1' then 'Urgent' when '2' then 'High'
              when '3' then 'Medium' when '4' then 'Not Specified' when '5' then 'Low'
              end as order_priority
  from orders left join deliveries on l_orderkey = o_orderkey
  left join customer on c_custkey = o_custkey),
priced as (
  select *, cast(l_extendedprice as decimal(10,2)) * (1 - cast(l_discount as decimal(5,2))) as net
  from lineitem),
shop_lines as (
  select l_orderkey * 20 + l_linenumber as order_detail_id, l_orderkey as order_id,
         l_partkey as product_id, cast(l_quantity as integer) as quantity,
         cast(l_discount as decimal(5,2)) as discount, cast(l_tax as decimal(5,2)) as tax_rate,
         cast(net * (1 + cast(l_tax as decimal(5,2))) as decimal(10,2)) as total_price,
         cast(cast(net as decimal(10,2))
              - cast(p_retailprice as decimal(10,2)) * cast(l_quantity as integer)
              as decimal(10,2)) as profit
  from priced left join part on p_partkey = l_partkey)"""


def fact_of(name: str, lines: str, orders: str, customers: str, products: str, regions: str) -> str:
    """The sales fact over the given tables."""
    return f"""
{name}_totals as (
  select order_id, cast(sum(total_price) * 100 as hugeint) as total_cents
  from {lines} group by order_id),
{name} as (
  select o.order_date, cast(year(o.order_date) as integer) as order_year,
         cast(quarter(o.order_date) as integer) as order_quarter,
         cast(month(o.order_date) as integer) as order_month,
         monthname(o.order_date) as order_month_name,
         cast(day(o.order_date) as integer) as order_day, dayname(o.order_date) as order_day_name,
         o.customer_id, l.product_id, o.region_id, o.order_id, l.order_detail_id,
         l.quantity, l.discount, l.tax_rate,
         cast(p.unit_price as decimal(10,2)) as unit_price,
         cast(p.cost_price as decimal(10,2)) as cost_price,
         l.total_price as revenue,
         cast(cast(p.cost_price as decimal(10,2)) * l.quantity as decimal(10,2)) as cost, l.profit,
         cast((2 * cast(o.shipping_cost * 100 as hugeint) * cast(l.total_price * 100 as hugeint)
               + total_cents) // (2 * total_cents) as bigint) as shipping_cents,
         case when l.total_price > 0 then
           sign(l.profit) * ((20000 * abs(cast(l.profit * 100 as hugeint))
             + cast(l.total_price * 100 as hugeint))
             // (2 * cast(l.total_price * 100 as hugeint))) / 10000.0::double end as profit_margin,
         cast(cast(p.unit_price as decimal(10,2)) * l.quantity * l.discount as decimal(10,2))
           as discount_amount,
         cast(cast(p.unit_price as decimal(10,2)) * l.quantity as decimal(10,2)) as gross_amount,
         o.ship_mode, o.payment_method, o.order_priority,
         cast(trunc(o.delivery_time_days) as integer) as delivery_time_days,
         coalesce(l.profit < 0, false) as is_loss_sale,
         coalesce(l.discount > 0, false) as is_discounted,
         coalesce(l.total_price > 50000, false) as is_high_value,
         coalesce(l.quantity > 25, false) as is_bulk_order,
         r.country as region_country, c.loyalty_status as customer_loyalty_status,
         c.first_name || ' ' || c.last_name as customer_full_name,
         p.category as product_category, p.subcategory as product_subcategory,
         p.supplier as product_supplier, r.region_name, r.manager as region_manager
  from {lines} l
  join {orders} o on o.order_id = l.order_id
  join {name}_totals t on t.order_id = l.order_id
  join {customers} c on c.customer_id = o.customer_id
  join {products} p on p.product_id = l.product_id
  join {regions} r on r.region_id = o.region_id)"""


FACT = fact_of(
    "fact", "shop_lines", "shop_orders", "shop_customers", "shop_products", "shop_regions"
)

RAW = """
raw_regions as (
  select * from shop_regions
  union all
  select region_id + 100, lower(country), lower(region_name), lower(manager)
  from shop_regions where region_id % 5 = 0),
mailed as (
  select *, 'customer#' || lpad(cast(case when customer_id % 10 = 1 then customer_id - 1
                                          else customer_id end as varchar), 9, '0')
            || case when customer_id % 20 = 1 then 'gmail.com' else '@gmail.com' end as address
  from shop_customers),
raw_customers as (
  select customer_id, first_name, last_name, country, city,
         case when customer_id % 33 = 0 then null
              when customer_id % 7 = 0 then ' ' || upper(address) else address end as email,
         signup_date,
         case when customer_id % 5 <> 0 then loyalty_status end as loyalty_status,
         case when customer_id % 13 <> 0 then age end as age
  from mailed),
raw_products as (
  select product_id, product_name,
         case when product_id % 4 = 0 then lower(category) else category end as category,
         subcategory, unit_price,
         case when product_id % 10 <> 0 then cost_price end as cost_price, supplier,
         case product_id % 4 when 0 then lower(stock_status) when 1 then upper(stock_status)
              else stock_status end as stock_status
  from shop_products),
raw_orders as (
  select order_id, order_date,
         case when order_id % 500 = 0 then -1 - customer_id else customer_id end as customer_id,
         case when region_id % 5 = 0 and order_id % 2 = 0 then region_id + 100
              else region_id end as region_id,
         case order_id % 3 when 0 then lower(ship_mode) when 1 then upper(ship_mode)
              else ship_mode end as ship_mode,
         case order_id % 3 when 0 then lower(payment_method) when 1 then upper(payment_method)
              else payment_method end as payment_method,
         delivery_time_days, shipping_cost,
         case order_id % 3 when 0 then lower(order_priority) when 1 then upper(order_priority)
              else order_priority end as order_priority
  from shop_orders),
damaged as (
  select order_detail_id, order_id,
         case when order_id % 700 = 0 then -1 - product_id else product_id end as product_id,
         quantity, case when order_id % 7 <> 0 then discount end as discount, tax_rate,
         total_price, case when order_id % 11 <> 0 then profit end as profit
  from shop_lines),
raw_lines as (
  select * from damaged
  union all
  select order_detail_id + 10, order_id, product_id, quantity, discount, tax_rate, total_price,
         profit
  from damaged where order_id % 50 = 0)"""


def title(column: str) -> str:
    """Upper-case the first letter of each run of letters."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda run: upper(left(run, 1)) || lower(substr(run, 2))), '')"
    )


def conformed(column: str, *standard: str) -> str:
    """Lower-case and upper-case spellings of the standard values."""
    cases = " ".join(
        f"when {column} in ('{s.lower()}', '{s.upper()}') then '{s}'" for s in standard
    )
    return f"case {cases} else {column} end"


MERGED = f"""
mended as (
  select *, lower(trim(email)) as plain from raw_customers),
repaired as (
  select * exclude (email, plain), email as email_original,
         case when contains(split_part(fixed, '@', 2), '.') then fixed end as email
  from (select *, case when contains(plain, '@') then plain
                       else replace(plain, 'gmail.com', '@gmail.com') end as fixed
        from mended)),
customer_places as (
  select *, case when email is not null then first_value(customer_id) over (
              partition by email order by signup_date nulls last, customer_id) end as primary_id
  from repaired),
customer_mapping as (
  select customer_id as old_customer_id, primary_id as new_customer_id
  from customer_places where primary_id <> customer_id),
survivors as (
  select * from customer_places where primary_id is null or primary_id = customer_id),
clean_customers as (
  select customer_id, first_name, last_name, {title("s.country")} as country,
         {title("city")} as city, email, email_original, signup_date,
         signup_date is null as signup_date_missing,
         coalesce(loyalty_status, 'Unclassified') as loyalty_status,
         coalesce(cast(age as double), median_age) as age
  from survivors s left join (
    select country, median(age) as median_age from survivors group by country) m
    on m.country = s.country),
spelled_regions as (
  select region_id, {title("country")} as country, upper(region_name) as region_name,
         {title("manager")} as manager
  from raw_regions),
region_places as (
  select *, min(region_id) over (partition by country, region_name, manager) as primary_id
  from spelled_regions),
region_mapping as (
  select region_id as old_region_id, primary_id as new_region_id
  from region_places where region_id <> primary_id),
clean_regions as (
  select region_id, country, region_name, manager from region_places
  where region_id = primary_id)"""

CLEANED = f"""
clean_products as (
  select product_id, product_name, {title("category")} as category,
         {title("subcategory")} as subcategory, unit_price,
         coalesce(cast(cost_price as double), cast(unit_price as double) * 0.70::double)
           as cost_price,
         supplier,
         {conformed("stock_status", "In Stock", "Low Stock", "Out of Stock")} as stock_status,
         cost_price is null as cost_price_imputed
  from raw_products),
moved_orders as (
  select o.* replace (coalesce(new_customer_id, customer_id) as customer_id,
                      coalesce(new_region_id, region_id) as region_id)
  from raw_orders o left join customer_mapping on old_customer_id = customer_id
  left join region_mapping on old_region_id = region_id),
spelled_orders as (
  select * replace (
    case lower(ship_mode) when 'express' then 'Express' when 'standard' then 'Standard'
         when 'overnight' then case when ship_mode = 'OVERNIGHT' then ship_mode
                                    else 'Overnight' end
         when 'economy' then case when ship_mode = 'ECONOMY' then ship_mode
                                  else 'Economy' end end as ship_mode,
    {conformed("payment_method", "Visa", "Mastercard", "PayPal")} as payment_method,
    {conformed("order_priority", "Low", "Medium", "High", "Urgent")} as order_priority)
  from moved_orders),
clean_orders as (
  select o.* replace (coalesce(cast(delivery_time_days as double), days) as delivery_time_days)
  from spelled_orders o left join (
    select ship_mode, median(delivery_time_days) as days from spelled_orders group by ship_mode) m
    on m.ship_mode = o.ship_mode),
single_lines as (
  select * from raw_lines
  qualify row_number() over (
    partition by order_id, product_id, quantity
    order by order_detail_id, discount nulls last, tax_rate, total_price,
             profit nulls last) = 1),
clean_lines as (
  select l.* replace (
           coalesce(l.discount, 0) as discount,
           coalesce(profit, cast(unit_price * quantity * (1 - coalesce(l.discount, 0))
             - cast(cost_price as decimal(12,4)) * quantity as decimal(10,2))) as profit),
         coalesce(coalesce(profit, cast(unit_price * quantity * (1 - coalesce(l.discount, 0))
             - cast(cost_price as decimal(12,4)) * quantity as decimal(10,2))) < 0, false)
           as is_loss_sale
  from single_lines l left join clean_products p on p.product_id = l.product_id)"""

CLEAN_FACT = fact_of(
    "clean_fact", "clean_lines", "clean_orders", "clean_customers", "clean_products",
    "clean_regions",
)


def over_shop(body: str) -> str:
    return f"with {CLEAN.strip()}\n{body.strip()}"


def over_fact(body: str) -> str:
    return f"with {CLEAN.strip()},{FACT}\n{body.strip()}"


def over_raw(body: str) -> str:
    return f"with {CLEAN.strip()},{RAW}\n{body.strip()}"


def over_cleaned(body: str) -> str:
    return f"with {CLEAN.strip()},{RAW},{MERGED},{CLEANED}\n{body.strip()}"


def over_clean_fact(body: str) -> str:
    return f"with {CLEAN.strip()},{RAW},{MERGED},{CLEANED},{CLEAN_FACT}\n{body.strip()}"


def over_both(body: str) -> str:
    return f"with {CLEAN.strip()},{FACT},{RAW},{MERGED},{CLEANED}\n{body.strip()}"
