"""The relational vocabulary over the shop views: one function per query shape.

Every function takes (spark, sf_dir) and parameters, returns a DataFrame and leaves
join strategy, pruning and pushdown to Catalyst. Limits always have the key as
tie-break. "Never" shapes are left anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.sources import tables as t

Group = str

#: What a group of lines can be keyed by, and the name of the result column.
GROUPS = {
    "category": ("category",),
    "segment": ("segment",),
    "city": ("city",),
    "product": ("product_id", "product_name"),
    "customer": ("customer_id", "customer_name"),
}


def customers_where(spark: SparkSession, d: str, condition: str) -> DataFrame:
    return t.customers(spark, d).filter(condition).select("name")


def products_where(spark: SparkSession, d: str, condition: str, *columns: str) -> DataFrame:
    return t.products(spark, d).filter(condition).select(*(columns or ("product_id", "name")))


def order_ids_where(spark: SparkSession, d: str, condition: str) -> DataFrame:
    return t.orders(spark, d).filter(condition).select("order_id")


def count_where(df: DataFrame, condition: str | Column, name: str = "n") -> DataFrame:
    return df.filter(condition).agg(F.count(F.lit(1)).alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_by(df: DataFrame, *keys: str, above: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out if above is None else out.filter(F.col("n") > above)


def price_by_category(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("price").cast("decimal(12,2)")
    return t.products(spark, d).groupBy("category").agg(
        (F.sum(price).cast("double") / F.count("price")).alias("avg_price"),
        F.sum(price).cast("double").alias("sum_price"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
    )


def top_products(spark: SparkSession, d: str, n: int, descending: bool) -> DataFrame:
    order = F.col("price").desc() if descending else F.col("price").asc()
    return t.products(spark, d).orderBy(order, "product_id").limit(n).select("product_id", "name", "price")


def top_customers_by_orders(spark: SparkSession, d: str, n: int, descending: bool) -> DataFrame:
    counted = t.orders(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.col("n").desc() if descending else F.col("n").asc()
    first = counted.orderBy(order, "customer_id").limit(n)
    return first.join(t.customers(spark, d), "customer_id").select("customer_id", "name", "n")


def orders_per_month(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    rows = t.orders(spark, d)
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.groupBy(t.month("order_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    counted = t.orders(spark, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(t.customers(spark, d), "customer_id").select("customer_id", "name", "n")


def lines(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """Items with their orders, and only those of ``status`` if given."""
    placed = t.orders(spark, d)
    placed = placed.filter(F.col("status") == status) if status else placed
    return t.order_items(spark, d).join(placed, "order_id")


def sales(spark: SparkSession, d: str, status: str | None = None, customers: bool = False) -> DataFrame:
    """Lines with products, and customers if asked for."""
    named = t.products(spark, d).withColumnRenamed("name", "product_name")
    out = lines(spark, d, status).join(named, "product_id")
    if customers:
        out = out.join(t.customers(spark, d).withColumnRenamed("name", "customer_name"), "customer_id")
    return out


def quantity_per_product(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    rows = lines(spark, d, status) if status else t.order_items(spark, d)
    summed = rows.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    return summed.join(t.products(spark, d), "product_id").select("product_id", "name", "quantity")


def customers_with_status(spark: SparkSession, d: str, status: str) -> DataFrame:
    placed = t.orders(spark, d).filter(F.col("status") == status)
    return t.customers(spark, d).join(placed, "customer_id", "left_semi").select("name").distinct()


def distinct_products(spark: SparkSession, d: str, status: str) -> DataFrame:
    return lines(spark, d, status).agg(F.countDistinct("product_id").alias("n"))


def average_quantity(spark: SparkSession, d: str) -> DataFrame:
    return t.order_items(spark, d).agg((F.sum("quantity") / F.count("quantity")).alias("avg_quantity"))


def revenue_total(spark: SparkSession, d: str, status: str) -> DataFrame:
    return sales(spark, d, status).agg(t.total_revenue())


def revenue_by(spark: SparkSession, d: str, group: Group, status: str | None = None) -> DataFrame:
    """Revenue per group, highest first.

    Per customer, lines are summed by id before the names are joined on, so that the
    join sees one row a customer; other groups are summed by name.
    """
    keys = GROUPS[group]
    if group == "customer":
        summed = sales(spark, d, status).groupBy("customer_id").agg(t.total_revenue())
        named = t.customers(spark, d).select("customer_id", F.col("name").alias("customer_name"))
        return summed.join(named, "customer_id").select(*keys, "revenue").orderBy(F.desc("revenue"), *keys)
    return sales(spark, d, status, group in ("segment", "city")).groupBy(*keys).agg(t.total_revenue()).orderBy(F.desc("revenue"), *keys)


def argmax_revenue(spark: SparkSession, d: str, group: Group, status: str) -> DataFrame:
    return revenue_by(spark, d, group, status).limit(1).select(*GROUPS[group])


def argmax_quantity(spark: SparkSession, d: str, group: Group, status: str | None = None) -> DataFrame:
    keys = GROUPS[group]
    return sales(spark, d, status).groupBy(*keys).agg(F.sum("quantity").alias("q")).orderBy(F.desc("q"), *keys).limit(1).select(*keys)


def order_values(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    value = F.sum(t.revenue()).alias("value")
    return sales(spark, d, status).groupBy("order_id", "customer_id").agg(value)


def _mean(column: str) -> Column:
    return F.sum(column).cast("double") / F.count(column)


def average_order_value(spark: SparkSession, d: str, status: str) -> DataFrame:
    return order_values(spark, d, status).agg(_mean("value").alias("avg_order_value"))


def segment_order_value(spark: SparkSession, d: str, status: str) -> DataFrame:
    """The segment with the highest mean order value."""
    joined = order_values(spark, d, status).join(t.customers(spark, d), "customer_id")
    return joined.groupBy("segment").agg(_mean("value").alias("aov")).orderBy(F.desc("aov"), "segment").limit(1).select("segment")


def orders_with_items(spark: SparkSession, d: str, condition: str) -> DataFrame:
    """Number of orders whose line count ``n`` meets the condition."""
    return count_where(t.order_items(spark, d).groupBy("order_id").agg(F.count(F.lit(1)).alias("n")), condition)


def multi_month_customers(spark: SparkSession, d: str, above: int) -> DataFrame:
    months = t.orders(spark, d).groupBy("customer_id").agg(F.countDistinct(t.month("order_date")).alias("months"))
    return count_where(months, F.col("months") > above)


def status_fraction(spark: SparkSession, d: str, status: str, scale: float = 1.0) -> DataFrame:
    hits = F.count(F.when(F.col("status") == status, 1))
    return t.orders(spark, d).agg((hits * F.lit(scale) / F.count(F.lit(1))).alias("fraction"))


def total_and_status_revenue(spark: SparkSession, d: str, status: str) -> DataFrame:
    part = F.sum(F.when(F.col("status") == status, t.revenue()).otherwise(F.lit(0).cast("decimal(24,4)"))).cast("double")
    return sales(spark, d).agg(t.total_revenue("total_revenue"), part.alias("status_revenue"))


def extreme_per_category(spark: SparkSession, d: str, highest: bool) -> DataFrame:
    """The dearest (or cheapest) products of each category, ties kept."""
    order = F.col("price").desc() if highest else F.col("price").asc()
    ranked = t.products(spark, d).withColumn("rank", F.rank().over(Window.partitionBy("category").orderBy(order)))
    return ranked.filter("rank = 1").select("category", "name")


def products_never(spark: SparkSession, d: str, status: str, least: float = 0, category: str | None = None) -> DataFrame:
    """Products in no line of ``least`` and more units in an order of ``status``."""
    rows = t.products(spark, d)
    rows = rows.filter(F.col("category") == category) if category else rows
    had = lines(spark, d, status).filter(F.col("quantity") >= least)
    return rows.join(had, "product_id", "left_anti").select("product_id", "name")


def customers_never(spark: SparkSession, d: str, status: str, since: str) -> DataFrame:
    """Customers without an order of ``status`` from ``since`` on."""
    had = t.orders(spark, d).filter((F.col("status") == status) & (F.col("order_date") >= F.lit(since).cast("timestamp_ntz")))
    return t.customers(spark, d).join(had, "customer_id", "left_anti").select("customer_id", "name")


def products_by_average_quantity(spark: SparkSession, d: str, above: float) -> DataFrame:
    means = t.order_items(spark, d).groupBy("product_id").agg((F.sum("quantity") / F.count("quantity")).alias("mean"))
    return means.filter(F.col("mean") > above).join(t.products(spark, d), "product_id").select("product_id", "name")


def revenue_per_month(spark: SparkSession, d: str, status: str) -> DataFrame:
    return sales(spark, d, status).groupBy(t.month("order_date").alias("month")).agg(t.total_revenue()).orderBy("month")
