"""Tables: the TPC-H-like Parquet inputs and the shop views over them.

The shop views give the query vocabulary its names: customers (city, segment),
products (category, price), orders (status, order_date) and order_items (quantity).
Revenue of a line is quantity times price, held as an exact decimal so that sums do
not depend on partitioning. Joins carry no broadcast hints: Catalyst broadcasts a
side only below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Completed orders carry this status.
COMPLETED = "F"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    return load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
    )


def month(column: str | Column) -> Column:
    """Two-digit month text."""
    return F.date_format(column, "MM")


def revenue() -> Column:
    """Exact revenue of a line that has quantity and price."""
    return F.col("quantity").cast("decimal(12,2)") * F.col("price").cast("decimal(12,2)")


def total_revenue(name: str = "revenue") -> Column:
    return F.sum(revenue()).cast("double").alias(name)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of all tables and the shop views, for SQL text."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, view in (("customers", customers), ("products", products), ("order_items", order_items)):
        view(spark, sf_dir).createOrReplaceTempView(name)
    orders(spark, sf_dir).createOrReplaceTempView("shop_orders")


def schema_text(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> str:
    """One line per table: its name and columns with types, for prompts."""
    described = ((n, load(spark, sf_dir, n).schema) for n in names)
    return "\n".join(f"{n}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)})" for n, schema in described)


def sample_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(n)


def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, position, column_name) of all tables, from their schemas."""
    rows = [(n, i, f.name) for n in TABLES for i, f in enumerate(load(spark, sf_dir, n).schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string")


def synthetic_shop(spark: SparkSession, n_customers: int = 20, n_products: int = 15, n_orders: int = 80, seed: int = 42) -> dict[str, DataFrame]:
    """A small shop with the views' columns, every value from a hash of its row.

    The last tenth of customers and the last fifth of products are never ordered,
    so set differences are not empty. Equal arguments give equal rows, however the
    ranges are partitioned.
    """

    def draw(n: int, *keys: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *(F.lit(k) if k[0] == "#" else F.col(k) for k in keys)), F.lit(n))

    def pick(values: tuple[str, ...], *keys: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(len(values), *keys) + 1).cast("int"))

    buyers, sold = max(1, n_customers - max(1, n_customers // 10)), max(1, n_products - max(1, n_products // 5))
    who = spark.range(1, n_customers + 1).withColumnRenamed("id", "customer_id")
    what = spark.range(1, n_products + 1).withColumnRenamed("id", "product_id")
    when = spark.range(1, n_orders + 1).withColumnRenamed("id", "order_id")
    cities, segments = ("North", "South", "East", "West", "Centre"), ("private", "business", "public")
    kinds, states = ("Lamp", "Chair", "Shelf", "Clock", "Table"), ("F", "F", "F", "O", "P")
    placed = when.select(
        "order_id",
        (draw(buyers, "#buyer", "order_id") + 1).alias("customer_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), draw(365, "#day", "order_id").cast("int")).alias("order_date"),
        pick(states, "#state", "order_id").alias("status"),
    )
    lines = when.select("order_id", F.explode(F.sequence(F.lit(1), (draw(4, "#lines", "order_id") + 1).cast("int"))).alias("line"))
    return {
        "customers": who.select(
            "customer_id",
            F.format_string("Customer %03d", "customer_id").alias("name"),
            pick(cities, "#city", "customer_id").alias("city"),
            pick(segments, "#segment", "customer_id").alias("segment"),
            draw(5000, "#balance", "customer_id").cast("double").alias("balance"),
        ),
        "products": what.select(
            "product_id",
            F.format_string("Product %03d", "product_id").alias("name"),
            pick(kinds, "#kind", "product_id").alias("category"),
            ((draw(90, "#price", "product_id") + 10) * 10).cast("double").alias("price"),
        ),
        "orders": placed,
        "order_items": lines.select(
            "order_id",
            "line",
            (draw(sold, "#product", "order_id", "line") + 1).alias("product_id"),
            (draw(5, "#quantity", "order_id", "line") + 1).cast("double").alias("quantity"),
        ),
    }
