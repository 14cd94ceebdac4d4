"""Queries of execution match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.operators import exec_match as em
from proofset.operators import vocabulary as v
from proofset.plans.relational import SHOP
from proofset.sources import tables as t


def _months(s: SparkSession, d: str, status: str) -> DataFrame:
    rows = t.orders(s, d).filter(F.col("status") == status)
    return rows.select(t.month("order_date").alias("m"), (F.col("customer_id") % 50).alias("c"))


def bag_differences(s: SparkSession, d: str) -> DataFrame:
    """Two different results as bags: what they don't share, with counts."""
    return em.differences(em.normalised(_months(s, d, "P")), em.normalised(_months(s, d, "O")))


def agreement(s: SparkSession, d: str) -> DataFrame:
    """One query written two ways: no row differs."""
    one = v.revenue_by(s, d, "category", "F").select("category", "revenue")
    other = v.sales(s, d, "F", customers=True).groupBy("category").agg(t.total_revenue())
    return em.differences(em.normalised(one), em.normalised(other)).agg(F.count(F.lit(1)).alias("n_different"))


def list_differences(s: SparkSession, d: str) -> DataFrame:
    """Two orders of the same rows, compared by position."""
    cheap, dear = (v.top_products(s, d, 40, x).select("product_id") for x in (False, True))
    return em.differences(em.normalised(cheap), em.normalised(dear), ordered=True).select("c0", F.col("__pos").alias("pos"), "n_a", "n_b")


def whole_list_differences(s: SparkSession, d: str) -> DataFrame:
    """Two orders of a whole table, compared by position."""
    rows = t.products(s, d)
    cheap, dear = (rows.orderBy(way, "product_id").select("product_id") for way in (F.asc("price"), F.desc("price")))
    return em.differences(em.normalised(cheap), em.normalised(dear), ordered=True).select("c0", F.col("__pos").alias("pos"), "n_a", "n_b")


def signatures(s: SparkSession, d: str) -> DataFrame:
    """Row counts of a few results whose signatures agree or not with their reordered selves."""
    out = None
    for name, df in (("categories", v.price_by_category(s, d)), ("months", v.orders_per_month(s, d)), ("top", v.top_products(s, d, 10, True))):
        a, b = em.signature(df), em.signature(df.orderBy(F.desc(df.columns[0])))
        met = a.join(b.withColumnRenamed("n_rows", "m"), "signature").select(F.lit(name).alias("name"), "n_rows")
        out = met if out is None else out.union(met)
    return out


_SIDES = """a AS (SELECT strftime(order_date, '%m') AS c0, CAST(customer_id % 50 AS DOUBLE) AS c1, 1 AS x, 0 AS y FROM shop_orders WHERE status = 'P'),
b AS (SELECT strftime(order_date, '%m') AS c0, CAST(customer_id % 50 AS DOUBLE) AS c1, 0 AS x, 1 AS y FROM shop_orders WHERE status = 'O')"""
_TOP = "SELECT CAST(product_id AS DOUBLE) AS c0, row_number() OVER (ORDER BY price {way}, product_id) - 1 AS pos FROM products QUALIFY row_number() OVER (ORDER BY price {way}, product_id) <= 40"
_ALL = "SELECT CAST(product_id AS DOUBLE) AS c0, row_number() OVER (ORDER BY price {way}, product_id) - 1 AS pos FROM products"

QUERIES = {
    "exec_match_bag": (
        bag_differences,
        f"{SHOP}, {_SIDES} SELECT c0, c1, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY c0, c1 HAVING sum(x) <> sum(y)",
    ),
    "exec_match_self": (agreement, "SELECT CAST(0 AS BIGINT) AS n_different"),
    "exec_match_list": (
        list_differences,
        f"{SHOP}, l AS ({_TOP.format(way='')}), r AS ({_TOP.format(way='DESC')}) SELECT c0, pos, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM (SELECT c0, pos, 1 AS x, 0 AS y FROM l UNION ALL SELECT c0, pos, 0, 1 FROM r) GROUP BY c0, pos HAVING sum(x) <> sum(y)",
    ),
    "exec_match_list_whole": (
        whole_list_differences,
        f"{SHOP}, l AS ({_ALL.format(way='')}), r AS ({_ALL.format(way='DESC')}) SELECT c0, pos, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM (SELECT c0, pos, 1 AS x, 0 AS y FROM l UNION ALL SELECT c0, pos, 0, 1 FROM r) GROUP BY c0, pos HAVING sum(x) <> sum(y)",
    ),
    "signature_table": (
        signatures,
        "SELECT 'categories' AS name, count(DISTINCT p_type) AS n_rows FROM part UNION ALL SELECT 'months', count(DISTINCT strftime(o_orderdate, '%m')) FROM orders UNION ALL SELECT 'top', least(count(*), 10) FROM part",
    ),
}
