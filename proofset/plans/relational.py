"""Queries of the relational vocabulary, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofset.operators import vocabulary as v
from proofset.sources import tables as t

SHOP = """WITH customers AS (
  SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
products AS (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS price FROM part),
shop_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_orderstatus AS status FROM orders),
order_items AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product_id, l_quantity AS quantity FROM lineitem),
sales AS (
  SELECT i.order_id, i.product_id, i.quantity, o.customer_id, o.order_date, o.status, p.name AS product_name, p.category,
         CAST(i.quantity AS DECIMAL(12,2)) * CAST(p.price AS DECIMAL(12,2)) AS revenue
  FROM order_items i JOIN shop_orders o ON o.order_id = i.order_id JOIN products p ON p.product_id = i.product_id)
"""
REV = "CAST(sum(revenue) AS DOUBLE)"


def _revenue_sql(keys: str, where: str = "", customers: bool = False) -> str:
    join = "JOIN customers c ON c.customer_id = sales.customer_id" if customers else ""
    return f"{SHOP} SELECT {keys}, {REV} AS revenue FROM sales {join} {where} GROUP BY {keys.replace(' AS customer_name', '')}"


def _argmax_sql(keys: str, measure: str, where: str, customers: bool = False) -> str:
    join = "JOIN customers c ON c.customer_id = sales.customer_id" if customers else ""
    plain = keys.replace(" AS customer_name", "")
    return f"{SHOP} SELECT {keys} FROM sales {join} {where} GROUP BY {plain} ORDER BY {measure} DESC, {plain} LIMIT 1"


F_ = "WHERE status = 'F'"
CUSTOMER = "sales.customer_id, c.name AS customer_name"

#: name: (query, SQL)
QUERIES = {
    "filter_city": (lambda s, d: v.customers_where(s, d, "city = 'NATION_7'"), f"{SHOP} SELECT name FROM customers WHERE city = 'NATION_7'"),
    "filter_segment": (lambda s, d: v.customers_where(s, d, "segment = 'BUILDING'"), f"{SHOP} SELECT name FROM customers WHERE segment = 'BUILDING'"),
    "filter_category": (lambda s, d: v.products_where(s, d, "category = 'PROMO'"), f"{SHOP} SELECT product_id, name FROM products WHERE category = 'PROMO'"),
    "filter_price": (lambda s, d: v.products_where(s, d, "price > 950"), f"{SHOP} SELECT product_id, name FROM products WHERE price > 950"),
    "filter_price_at_least": (lambda s, d: v.products_where(s, d, "price >= 990"), f"{SHOP} SELECT product_id, name FROM products WHERE price >= 990"),
    "filter_price_below": (lambda s, d: v.products_where(s, d, "price < 910"), f"{SHOP} SELECT product_id, name FROM products WHERE price < 910"),
    "filter_conj": (
        lambda s, d: v.products_where(s, d, "category = 'SMALL' AND price > 960"),
        f"{SHOP} SELECT product_id, name FROM products WHERE category = 'SMALL' AND price > 960",
    ),
    "filter_city_segment": (
        lambda s, d: v.customers_where(s, d, "city = 'NATION_3' AND segment = 'MACHINERY'"),
        f"{SHOP} SELECT name FROM customers WHERE city = 'NATION_3' AND segment = 'MACHINERY'",
    ),
    "filter_status": (lambda s, d: v.order_ids_where(s, d, "status = 'P'"), f"{SHOP} SELECT order_id FROM shop_orders WHERE status = 'P'"),
    "filter_date_range": (
        lambda s, d: v.order_ids_where(s, d, "order_date >= TIMESTAMP_NTZ '1997-03-01' AND order_date < TIMESTAMP_NTZ '1997-06-01'"),
        f"{SHOP} SELECT order_id FROM shop_orders WHERE order_date >= TIMESTAMP '1997-03-01' AND order_date < TIMESTAMP '1997-06-01'",
    ),
    "lookup_price": (
        lambda s, d: v.products_where(s, d, "name = 'red widget'", "product_id", "price"),
        f"{SHOP} SELECT product_id, price FROM products WHERE name = 'red widget'",
    ),
    "lookup_customer": (
        lambda s, d: t.customers(s, d).filter("name = 'Customer#000000042'").select("city", "segment", "balance"),
        f"{SHOP} SELECT city, segment, balance FROM customers WHERE name = 'Customer#000000042'",
    ),
    "distinct_city": (lambda s, d: v.distinct_values(t.customers(s, d), "city"), f"{SHOP} SELECT DISTINCT city FROM customers"),
    "distinct_segment": (lambda s, d: v.distinct_values(t.customers(s, d), "segment"), f"{SHOP} SELECT DISTINCT segment FROM customers"),
    "distinct_category": (lambda s, d: v.distinct_values(t.products(s, d), "category"), f"{SHOP} SELECT DISTINCT category FROM products"),
    "distinct_status": (lambda s, d: v.distinct_values(t.orders(s, d), "status"), f"{SHOP} SELECT DISTINCT status FROM shop_orders"),
    "count_all": (lambda s, d: v.count_where(t.customers(s, d), "true"), f"{SHOP} SELECT count(*) AS n FROM customers"),
    "count_city": (lambda s, d: v.count_where(t.customers(s, d), "city = 'NATION_7'"), f"{SHOP} SELECT count(*) AS n FROM customers WHERE city = 'NATION_7'"),
    "count_category": (lambda s, d: v.count_where(t.products(s, d), "category = 'LARGE'"), f"{SHOP} SELECT count(*) AS n FROM products WHERE category = 'LARGE'"),
    "count_status": (lambda s, d: v.count_where(t.orders(s, d), "status = 'F'"), f"{SHOP} SELECT count(*) AS n FROM shop_orders WHERE status = 'F'"),
    "count_in_month": (
        lambda s, d: v.count_where(t.orders(s, d), t.month("order_date") == "03"),
        f"{SHOP} SELECT count(*) AS n FROM shop_orders WHERE strftime(order_date, '%m') = '03'",
    ),
    "count_status_month": (
        lambda s, d: v.count_where(t.orders(s, d), (F.col("status") == "O") & (t.month("order_date") == "11")),
        f"{SHOP} SELECT count(*) AS n FROM shop_orders WHERE status = 'O' AND strftime(order_date, '%m') = '11'",
    ),
    "count_by_city": (lambda s, d: v.count_by(t.customers(s, d), "city"), f"{SHOP} SELECT city, count(*) AS n FROM customers GROUP BY city"),
    "count_by_segment": (lambda s, d: v.count_by(t.customers(s, d), "segment"), f"{SHOP} SELECT segment, count(*) AS n FROM customers GROUP BY segment"),
    "count_by_category": (lambda s, d: v.count_by(t.products(s, d), "category"), f"{SHOP} SELECT category, count(*) AS n FROM products GROUP BY category"),
    "count_by_status": (lambda s, d: v.count_by(t.orders(s, d), "status"), f"{SHOP} SELECT status, count(*) AS n FROM shop_orders GROUP BY status"),
    "having_count_city": (
        lambda s, d: v.count_by(t.customers(s, d), "city", above=60),
        f"{SHOP} SELECT city, count(*) AS n FROM customers GROUP BY city HAVING count(*) > 60",
    ),
    "having_count_segment": (
        lambda s, d: v.count_by(t.customers(s, d), "segment", above=290),
        f"{SHOP} SELECT segment, count(*) AS n FROM customers GROUP BY segment HAVING count(*) > 290",
    ),
    "agg_price_by_category": (
        v.price_by_category,
        f"""{SHOP} SELECT category, CAST(sum(CAST(price AS DECIMAL(12,2))) AS DOUBLE) / count(price) AS avg_price,
        CAST(sum(CAST(price AS DECIMAL(12,2))) AS DOUBLE) AS sum_price, max(price) AS max_price, min(price) AS min_price
        FROM products GROUP BY category""",
    ),
    "topn_products_desc": (
        lambda s, d: v.top_products(s, d, 10, True),
        f"{SHOP} SELECT product_id, name, price FROM products ORDER BY price DESC, product_id LIMIT 10",
    ),
    "topn_products_asc": (
        lambda s, d: v.top_products(s, d, 5, False),
        f"{SHOP} SELECT product_id, name, price FROM products ORDER BY price, product_id LIMIT 5",
    ),
    "topn_customers_by_orders_desc": (
        lambda s, d: v.top_customers_by_orders(s, d, 10, True),
        f"""{SHOP} SELECT c.customer_id, c.name, count(*) AS n FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id
        GROUP BY c.customer_id, c.name ORDER BY n DESC, c.customer_id LIMIT 10""",
    ),
    "topn_customers_by_orders_asc": (
        lambda s, d: v.top_customers_by_orders(s, d, 3, False),
        f"""{SHOP} SELECT c.customer_id, c.name, count(*) AS n FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id
        GROUP BY c.customer_id, c.name ORDER BY n, c.customer_id LIMIT 3""",
    ),
    "orders_per_month": (
        v.orders_per_month,
        f"{SHOP} SELECT strftime(order_date, '%m') AS month, count(*) AS n FROM shop_orders GROUP BY 1",
    ),
    "orders_per_month_status": (
        lambda s, d: v.orders_per_month(s, d, "F"),
        f"{SHOP} SELECT strftime(order_date, '%m') AS month, count(*) AS n FROM shop_orders WHERE status = 'F' GROUP BY 1",
    ),
    "orders_per_customer": (
        v.orders_per_customer,
        f"""{SHOP} SELECT c.customer_id, c.name, count(*) AS n FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id
        GROUP BY c.customer_id, c.name""",
    ),
    "qty_per_product": (
        v.quantity_per_product,
        f"""{SHOP} SELECT p.product_id, p.name, sum(i.quantity) AS quantity FROM products p JOIN order_items i ON i.product_id = p.product_id
        GROUP BY p.product_id, p.name""",
    ),
    "qty_per_product_status": (
        lambda s, d: v.quantity_per_product(s, d, "F"),
        f"{SHOP} SELECT product_id, product_name AS name, sum(quantity) AS quantity FROM sales {F_} GROUP BY product_id, product_name",
    ),
    "customers_with_status": (
        lambda s, d: v.customers_with_status(s, d, "P"),
        f"{SHOP} SELECT DISTINCT c.name FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id WHERE o.status = 'P'",
    ),
    "distinct_products_in_status": (
        lambda s, d: v.distinct_products(s, d, "P"),
        f"{SHOP} SELECT count(DISTINCT product_id) AS n FROM sales WHERE status = 'P'",
    ),
    "avg_qty_per_item": (v.average_quantity, f"{SHOP} SELECT sum(quantity) / count(quantity) AS avg_quantity FROM order_items"),
    "revenue_total": (lambda s, d: v.revenue_total(s, d, "F"), f"{SHOP} SELECT {REV} AS revenue FROM sales {F_}"),
    "revenue_by_category": (lambda s, d: v.revenue_by(s, d, "category", "F"), _revenue_sql("category", F_)),
    "revenue_by_segment": (lambda s, d: v.revenue_by(s, d, "segment", "F"), _revenue_sql("segment", F_, True)),
    "revenue_by_city": (lambda s, d: v.revenue_by(s, d, "city", "F"), _revenue_sql("city", F_, True)),
    "revenue_by_product": (lambda s, d: v.revenue_by(s, d, "product", "F"), _revenue_sql("product_id, product_name", F_)),
    "revenue_by_customer": (lambda s, d: v.revenue_by(s, d, "customer", "F"), _revenue_sql(CUSTOMER, F_, True)),
    "revenue_by_category_all": (lambda s, d: v.revenue_by(s, d, "category"), _revenue_sql("category")),
    "revenue_by_segment_all": (lambda s, d: v.revenue_by(s, d, "segment"), _revenue_sql("segment", "", True)),
    "revenue_by_city_all": (lambda s, d: v.revenue_by(s, d, "city"), _revenue_sql("city", "", True)),
    "revenue_by_product_all": (lambda s, d: v.revenue_by(s, d, "product"), _revenue_sql("product_id, product_name")),
    "argmax_revenue_product": (lambda s, d: v.argmax_revenue(s, d, "product", "F"), _argmax_sql("product_id, product_name", "sum(revenue)", F_)),
    "argmax_revenue_customer": (lambda s, d: v.argmax_revenue(s, d, "customer", "F"), _argmax_sql(CUSTOMER, "sum(revenue)", F_, True)),
    "argmax_revenue_category": (lambda s, d: v.argmax_revenue(s, d, "category", "F"), _argmax_sql("category", "sum(revenue)", F_)),
    "argmax_revenue_city": (lambda s, d: v.argmax_revenue(s, d, "city", "F"), _argmax_sql("city", "sum(revenue)", F_, True)),
    "argmax_qty_category": (lambda s, d: v.argmax_quantity(s, d, "category"), _argmax_sql("category", "sum(quantity)", "")),
    "argmax_qty_category_status": (lambda s, d: v.argmax_quantity(s, d, "category", "P"), _argmax_sql("category", "sum(quantity)", "WHERE status = 'P'")),
    "argmax_qty_product_status": (
        lambda s, d: v.argmax_quantity(s, d, "product", "P"),
        _argmax_sql("product_id, product_name", "sum(quantity)", "WHERE status = 'P'"),
    ),
    "avg_order_value": (
        lambda s, d: v.average_order_value(s, d, "F"),
        f"{SHOP} SELECT CAST(sum(value) AS DOUBLE) / count(value) AS avg_order_value FROM (SELECT sum(revenue) AS value FROM sales {F_} GROUP BY order_id)",
    ),
    "segment_aov": (
        lambda s, d: v.segment_order_value(s, d, "F"),
        f"""{SHOP} SELECT segment FROM (SELECT c.segment, CAST(sum(value) AS DOUBLE) / count(value) AS aov
        FROM (SELECT customer_id, sum(revenue) AS value FROM sales {F_} GROUP BY order_id, customer_id) t
        JOIN customers c ON c.customer_id = t.customer_id GROUP BY c.segment ORDER BY aov DESC, c.segment LIMIT 1)""",
    ),
    "orders_with_more_items": (
        lambda s, d: v.orders_with_items(s, d, "n > 4"),
        f"{SHOP} SELECT count(*) AS n FROM (SELECT order_id FROM order_items GROUP BY order_id HAVING count(*) > 4)",
    ),
    "orders_with_at_least_items": (
        lambda s, d: v.orders_with_items(s, d, "n >= 4"),
        f"{SHOP} SELECT count(*) AS n FROM (SELECT order_id FROM order_items GROUP BY order_id HAVING count(*) >= 4)",
    ),
    "orders_with_exact_items": (
        lambda s, d: v.orders_with_items(s, d, "n = 4"),
        f"{SHOP} SELECT count(*) AS n FROM (SELECT order_id FROM order_items GROUP BY order_id HAVING count(*) = 4)",
    ),
    "active_multi_month": (
        lambda s, d: v.multi_month_customers(s, d, 6),
        f"{SHOP} SELECT count(*) AS n FROM (SELECT customer_id FROM shop_orders GROUP BY customer_id HAVING count(DISTINCT strftime(order_date, '%m')) > 6)",
    ),
    "status_fraction": (
        lambda s, d: v.status_fraction(s, d, "F"),
        f"{SHOP} SELECT count(*) FILTER (WHERE status = 'F') * 1.0e0 / count(*) AS fraction FROM shop_orders",
    ),
    "status_percentage": (
        lambda s, d: v.status_fraction(s, d, "F", 100.0),
        f"{SHOP} SELECT count(*) FILTER (WHERE status = 'F') * 100.0e0 / count(*) AS fraction FROM shop_orders",
    ),
    "total_vs_status_revenue": (
        lambda s, d: v.total_and_status_revenue(s, d, "F"),
        f"{SHOP} SELECT {REV} AS total_revenue, CAST(sum(CASE WHEN status = 'F' THEN revenue ELSE 0 END) AS DOUBLE) AS status_revenue FROM sales",
    ),
    "max_per_group": (
        lambda s, d: v.extreme_per_category(s, d, True),
        f"""{SHOP} SELECT p.category, p.name FROM products p JOIN (SELECT category, max(price) AS x FROM products GROUP BY category) m
        ON m.category = p.category AND p.price = m.x""",
    ),
    "extreme_per_group": (
        lambda s, d: v.extreme_per_category(s, d, False),
        f"""{SHOP} SELECT p.category, p.name FROM products p JOIN (SELECT category, min(price) AS x FROM products GROUP BY category) m
        ON m.category = p.category AND p.price = m.x""",
    ),
    "never_in_status": (
        lambda s, d: v.products_never(s, d, "P", 40),
        f"""{SHOP} SELECT product_id, name FROM products WHERE product_id NOT IN
        (SELECT product_id FROM sales WHERE status = 'P' AND quantity >= 40)""",
    ),
    "never_ordered_in_category": (
        lambda s, d: v.products_never(s, d, "P", 40, "PROMO"),
        f"""{SHOP} SELECT product_id, name FROM products WHERE category = 'PROMO' AND product_id NOT IN
        (SELECT product_id FROM sales WHERE status = 'P' AND quantity >= 40)""",
    ),
    "never_ordered_products": (
        lambda s, d: v.products_never(s, d, "F", 48),
        f"""{SHOP} SELECT product_id, name FROM products WHERE product_id NOT IN
        (SELECT product_id FROM sales WHERE status = 'F' AND quantity >= 48)""",
    ),
    "never_ordered_customers": (
        lambda s, d: v.customers_never(s, d, "F", "1999-01-01"),
        f"""{SHOP} SELECT customer_id, name FROM customers WHERE customer_id NOT IN
        (SELECT customer_id FROM shop_orders WHERE status = 'F' AND order_date >= TIMESTAMP '1999-01-01')""",
    ),
    "avg_qty_having": (
        lambda s, d: v.products_by_average_quantity(s, d, 27),
        f"""{SHOP} SELECT p.product_id, p.name FROM order_items i JOIN products p ON p.product_id = i.product_id
        GROUP BY p.product_id, p.name HAVING sum(i.quantity) / count(i.quantity) > 27""",
    ),
    "revenue_per_month": (
        lambda s, d: v.revenue_per_month(s, d, "F"),
        f"{SHOP} SELECT strftime(order_date, '%m') AS month, {REV} AS revenue FROM sales {F_} GROUP BY 1",
    ),
    "list_columns": (
        t.column_list,
        f"""SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name FROM information_schema.columns
        WHERE table_name IN ({", ".join(f"'{n}'" for n in t.TABLES)})""",
    ),
    "sample_rows": (lambda s, d: t.sample_rows(t.products(s, d), "product_id"), f"{SHOP} SELECT * FROM products ORDER BY product_id LIMIT 3"),
}
