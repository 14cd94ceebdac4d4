"""Question and query generation: templates, slots, enumeration, validation, corpus.

A template is a body that names what is asked, openers that ask it, slots and variants,
and a gold statement over the shop views. Enumeration is relational: one row per
template, exploded by variants, slot values and openers. Each distinct gold runs once,
many of them to a job, before results are joined back.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from proofset.functions import stats
from proofset.functions import text as tx
from proofset.operators import exec_match, splits
from proofset.sources.records import cut, scratch_path

OPENERS = (
    "Return {body}.", "Which query gives {body}?", "I need {body}.", "Find {body}.", "Please work out {body}.",
    "Can you give me {body}?", "Write SQL for {body}.", "A report should show {body}.", "From the shop's tables, get {body}.",
)
ENUMERATION_CAP = 400
# ---- Fixed values: thresholds that no table gives, quantiles of prices, bounds ----
SLOT_CONSTANTS = {"count_threshold": (2, 3, 4), "qty_threshold": (2, 3), "n_limit": (3, 5, 10)}
PRICE_QUANTILES = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
LEVEL_MIX = [("easy", 0.25), ("medium", 0.40), ("hard", 0.35)]
RESERVED_SHARE = 0.55
#: How many ways of asking each family has.
PHRASINGS = {
    "cust_by_city": 6, "cust_by_segment": 6, "prod_by_category": 6, "count_cust_by_city": 3, "count_prod_by_category": 6,
    "count_orders_by_status": 3, "price_of_product": 6, "attr_of_customer": 6, "distinct_col": 6, "prod_price_compare": 6,
    "order_ids_by_status": 3, "prod_in_cat_above_price": 6, "count_by_group": 5, "agg_price_by_category": 6, "having_count": 3,
    "topn_products_by_price": 3, "orders_per_month": 3, "orders_per_customer": 3, "qty_per_product": 3, "never_ordered_products": 3,
    "signup_after": 6, "distinct_products_in_status": 3, "customers_with_status_order": 3, "avg_qty_per_order_item": 3, "count_orders_in_month": 6,
    "revenue_total_status": 7, "revenue_by_group": 6, "argmax_revenue_by_group": 6, "avg_order_value": 6, "orders_with_n_items": 6,
    "status_fraction": 6, "max_per_group": 3, "never_in_status": 6, "total_vs_status_revenue": 6, "active_multi_month": 6,
    "revenue_per_month": 6, "topn_customers_by_orders": 6, "customers_by_city_segment": 6, "revenue_by_group_all": 5, "orders_count_by_status_month": 6,
    "avg_qty_having": 6, "argmax_qty_category": 3, "segment_avg_order_value": 6, "never_ordered_customers": 6, "orders_per_month_status": 4,
    "qty_per_product_status": 4, "never_ordered_in_category": 4, "extreme_per_group": 4, "argmax_qty_group_status": 4,
}
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    family: str
    level: str
    body: str
    gold: str
    slots: tuple[str, ...] = ()
    variants: tuple[dict[str, str], ...] = ({},)
    multi_row: bool = False

    @property
    def openers(self) -> tuple[str, ...]:
        return OPENERS[: PHRASINGS[self.family]]


SALES = "order_items i JOIN shop_orders o ON o.order_id = i.order_id JOIN products p ON p.product_id = i.product_id"
BUYERS = f"{SALES} JOIN customers c ON c.customer_id = o.customer_id"
REVENUE = "sum(i.quantity * p.price)"


def _each(name: str, *values: str) -> tuple[dict[str, str], ...]:
    return tuple({name: v} for v in values)


def _tables(**columns: str) -> tuple[dict[str, str], ...]:
    return tuple({"column": c, "table": t} for c, t in columns.items())


WHERE = "WHERE o.status = '{status}'"
COLUMNS = _tables(city="customers", segment="customers", category="products", status="shop_orders")
GROUPED = ({"column": "p.category", "what": "category"}, {"column": "c.segment", "what": "segment"}, {"column": "c.city", "what": "city"},
           {"column": "p.name", "what": "product"}, {"column": "c.name", "what": "customer"})
ENDS = ({"way": "DESC", "end": "highest"}, {"way": "ASC", "end": "lowest"})

TEMPLATES = (
    Template("cust_by_city", "easy", "names of customers in city {city}", "SELECT name FROM customers WHERE city = '{city}'", ("city",)),
    Template("cust_by_segment", "easy", "names of customers in segment {segment}", "SELECT name FROM customers WHERE segment = '{segment}'", ("segment",)),
    Template("prod_by_category", "easy", "names of products in category {category}", "SELECT name FROM products WHERE category = '{category}'", ("category",)),
    Template("count_cust_by_city", "easy", "the number of customers in city {city}", "SELECT count(*) FROM customers WHERE city = '{city}'", ("city",)),
    Template("count_prod_by_category", "easy", "the number of products in category {category}", "SELECT count(*) FROM products WHERE category = '{category}'", ("category",)),
    Template("count_orders_by_status", "easy", "the number of orders in status {status}", "SELECT count(*) FROM shop_orders WHERE status = '{status}'", ("status",)),
    Template("price_of_product", "easy", "the price of product {product_name}", "SELECT price FROM products WHERE name = '{product_name}'", ("product_name",)),
    Template("attr_of_customer", "easy", "the {column} of customer {customer_name}", "SELECT {column} FROM customers WHERE name = '{customer_name}'", ("customer_name",), _each("column", "city", "segment", "balance")),
    Template("distinct_col", "easy", "every distinct {column} of {table}", "SELECT DISTINCT {column} FROM {table}", variants=COLUMNS, multi_row=True),
    Template("prod_price_compare", "easy", "names of products with a price {sign} {price_threshold}", "SELECT name FROM products WHERE price {sign} {price_threshold}", ("price_threshold",), _each("sign", ">", "<", ">=")),
    Template("order_ids_by_status", "easy", "ids of orders in status {status}", "SELECT order_id FROM shop_orders WHERE status = '{status}'", ("status",)),
    Template("prod_in_cat_above_price", "easy", "names of {category} products above {price_threshold}", "SELECT name FROM products WHERE category = '{category}' AND price > {price_threshold}", ("category", "price_threshold")),
    Template("count_by_group", "medium", "the row count of {table} per {column}", "SELECT {column}, count(*) FROM {table} GROUP BY {column}", variants=COLUMNS, multi_row=True),
    Template("agg_price_by_category", "medium", "the {fn} of prices per category", "SELECT category, {fn}(price) FROM products GROUP BY category", variants=_each("fn", "avg", "sum", "max", "min"), multi_row=True),
    Template("having_count", "medium", "each {column} with over {count_threshold} customers, and their count", "SELECT {column}, count(*) FROM customers GROUP BY {column} HAVING count(*) > {count_threshold}", ("count_threshold",), _each("column", "city", "segment")),
    Template("topn_products_by_price", "medium", "the {n_limit} products with the {end} price, with prices", "SELECT name, price FROM products ORDER BY price {way}, product_id LIMIT {n_limit}", ("n_limit",), ENDS),
    Template("orders_per_month", "medium", "the order count per month", "SELECT date_format(order_date, 'MM') AS m, count(*) FROM shop_orders GROUP BY m", multi_row=True),
    Template("orders_per_customer", "medium", "each customer's name and order count", "SELECT c.name, count(*) FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id GROUP BY c.customer_id, c.name", multi_row=True),
    Template("qty_per_product", "medium", "each product's name and ordered quantity", "SELECT p.name, sum(i.quantity) FROM products p JOIN order_items i ON i.product_id = p.product_id GROUP BY p.product_id, p.name", multi_row=True),
    Template("never_ordered_products", "medium", "names of products that nobody ordered", "SELECT name FROM products WHERE product_id NOT IN (SELECT product_id FROM order_items)"),
    Template("signup_after", "medium", "ids of orders dated {when} {signup_cut}", "SELECT order_id FROM shop_orders WHERE order_date {sign} '{signup_cut}'", ("signup_cut",), ({"sign": ">=", "when": "from"}, {"sign": "<", "when": "before"})),
    Template("distinct_products_in_status", "medium", "how many different products {status} orders have", f"SELECT count(DISTINCT i.product_id) FROM {SALES} {WHERE}", ("status",)),
    Template("customers_with_status_order", "medium", "distinct names of customers with a {status} order", "SELECT DISTINCT c.name FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id WHERE o.status = '{status}'", ("status",)),
    Template("avg_qty_per_order_item", "medium", "the mean quantity of a line", "SELECT avg(quantity) FROM order_items"),
    Template("count_orders_in_month", "medium", "the number of orders in month {month}", "SELECT count(*) FROM shop_orders WHERE date_format(order_date, 'MM') = '{month}'", ("month",)),
    Template("revenue_total_status", "hard", "the revenue of {status} orders", f"SELECT {REVENUE} FROM {SALES} {WHERE}", ("status",)),
    Template("revenue_by_group", "hard", "the revenue of {status} orders per {what}, highest first", f"SELECT {{column}}, {REVENUE} AS r FROM {BUYERS} {WHERE} GROUP BY {{column}} ORDER BY r DESC", ("status",), GROUPED, True),
    Template("argmax_revenue_by_group", "hard", "the {what} with the most revenue from {status} orders", f"SELECT {{column}} FROM {BUYERS} {WHERE} GROUP BY {{column}} ORDER BY {REVENUE} DESC, {{column}} LIMIT 1", ("status",), GROUPED[:1] + GROUPED[2:]),
    Template("avg_order_value", "hard", "the mean value of a {status} order", f"SELECT avg(v) FROM (SELECT {REVENUE} AS v FROM {SALES} {WHERE} GROUP BY o.order_id)", ("status",)),
    Template("orders_with_n_items", "hard", "how many orders have {sign} {count_threshold} lines", "SELECT count(*) FROM (SELECT order_id FROM order_items GROUP BY order_id HAVING count(*) {sign} {count_threshold})", ("count_threshold",), _each("sign", ">", ">=", "=")),
    Template("status_fraction", "hard", "the {unit} of orders in status {status}", "SELECT (SELECT count(*) FROM shop_orders WHERE status = '{status}') * {scale} / (SELECT count(*) FROM shop_orders)", ("status",), ({"scale": "1.0e0", "unit": "fraction"}, {"scale": "100.0e0", "unit": "percentage"})),
    Template("max_per_group", "hard", "category and name of each category's dearest product", "SELECT p.category, p.name FROM products p JOIN (SELECT category, max(price) AS x FROM products GROUP BY category) m ON m.category = p.category AND p.price = m.x", multi_row=True),
    Template("never_in_status", "hard", "names of products in no {status} order", f"SELECT name FROM products WHERE product_id NOT IN (SELECT i.product_id FROM {SALES} {WHERE})", ("status",)),
    Template("total_vs_status_revenue", "hard", "all revenue beside the revenue of {status} orders", f"SELECT {REVENUE}, sum(CASE WHEN o.status = '{{status}}' THEN i.quantity * p.price ELSE 0 END) FROM {SALES}", ("status",)),
    Template("active_multi_month", "hard", "how many customers ordered in over {count_threshold} months", "SELECT count(*) FROM (SELECT customer_id FROM shop_orders GROUP BY customer_id HAVING count(DISTINCT date_format(order_date, 'MM')) > {count_threshold})", ("count_threshold",)),
    Template("revenue_per_month", "hard", "the revenue of {status} orders by month, in order", f"SELECT date_format(o.order_date, 'MM') AS m, {REVENUE} FROM {SALES} {WHERE} GROUP BY m ORDER BY m", ("status",), multi_row=True),
    Template("topn_customers_by_orders", "hard", "the {n_limit} customers with the {end} order counts, with counts", "SELECT c.name, count(*) AS n FROM customers c JOIN shop_orders o ON o.customer_id = c.customer_id GROUP BY c.customer_id, c.name ORDER BY n {way}, c.customer_id LIMIT {n_limit}", ("n_limit",), ENDS, True),
    Template("customers_by_city_segment", "hard", "names of {segment} customers in city {city}", "SELECT name FROM customers WHERE city = '{city}' AND segment = '{segment}'", ("city", "segment")),
    Template("revenue_by_group_all", "hard", "the revenue of all orders per {what}, highest first", f"SELECT {{column}}, {REVENUE} AS r FROM {BUYERS} GROUP BY {{column}} ORDER BY r DESC", variants=GROUPED[:4], multi_row=True),
    Template("orders_count_by_status_month", "hard", "the number of {status} orders in month {month}", "SELECT count(*) FROM shop_orders WHERE status = '{status}' AND date_format(order_date, 'MM') = '{month}'", ("status", "month")),
    Template("avg_qty_having", "hard", "names of products with a mean quantity over {qty_threshold}", "SELECT p.name FROM order_items i JOIN products p ON p.product_id = i.product_id GROUP BY p.product_id, p.name HAVING avg(i.quantity) > {qty_threshold}", ("qty_threshold",)),
    Template("argmax_qty_category", "hard", "the category with the largest ordered quantity", "SELECT p.category FROM order_items i JOIN products p ON p.product_id = i.product_id GROUP BY p.category ORDER BY sum(i.quantity) DESC, p.category LIMIT 1"),
    Template("segment_avg_order_value", "hard", "the segment with the highest mean value of {status} orders", f"SELECT s FROM (SELECT c.segment AS s, avg(t.v) AS a FROM (SELECT o.order_id, o.customer_id, {REVENUE} AS v FROM {SALES} {WHERE} GROUP BY o.order_id, o.customer_id) t JOIN customers c ON c.customer_id = t.customer_id GROUP BY c.segment ORDER BY a DESC, s LIMIT 1)", ("status",)),
    Template("never_ordered_customers", "hard", "names of customers without orders", "SELECT name FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM shop_orders)"),
    Template("orders_per_month_status", "medium", "the count of {status} orders per month", "SELECT date_format(order_date, 'MM') AS m, count(*) FROM shop_orders WHERE status = '{status}' GROUP BY m", ("status",), multi_row=True),
    Template("qty_per_product_status", "medium", "each product's name and quantity in {status} orders", f"SELECT p.name, sum(i.quantity) FROM {SALES} {WHERE} GROUP BY p.product_id, p.name", ("status",), multi_row=True),
    Template("never_ordered_in_category", "medium", "names of {category} products that nobody ordered", "SELECT name FROM products WHERE category = '{category}' AND product_id NOT IN (SELECT product_id FROM order_items)", ("category",)),
    Template("extreme_per_group", "hard", "category and name of each category's cheapest product", "SELECT p.category, p.name FROM products p JOIN (SELECT category, min(price) AS x FROM products GROUP BY category) m ON m.category = p.category AND p.price = m.x", multi_row=True),
    Template("argmax_qty_group_status", "hard", "the {what} with the largest quantity in {status} orders", f"SELECT {{column}} FROM {SALES} {WHERE} GROUP BY {{column}} ORDER BY sum(i.quantity) DESC, {{column}} LIMIT 1", ("status",), GROUPED[:1] + GROUPED[3:4]),
)

#: The pattern that each near-variant stands in for, and the held-out patterns.
NEAR_VARIANTS = {
    "orders_per_month_status": "orders_per_month",
    "qty_per_product_status": "qty_per_product",
    "never_ordered_in_category": "never_ordered_products",
    "extreme_per_group": "max_per_group",
    "argmax_qty_group_status": "argmax_qty_category",
}
HELD_OUT_FAMILIES = (
    "prod_by_category", "distinct_col", "cust_by_segment", "count_prod_by_category", "agg_price_by_category", "orders_per_month",
    "never_ordered_products", "qty_per_product", "argmax_revenue_by_group", "avg_order_value", "argmax_qty_category", "avg_qty_having",
    "max_per_group", "segment_avg_order_value", "total_vs_status_revenue",
)
TEST_FAMILIES = tuple(sorted({*HELD_OUT_FAMILIES, *NEAR_VARIANTS}))


def register(spark: SparkSession, shop: dict[str, DataFrame]) -> None:
    for name, df in shop.items():
        df.createOrReplaceTempView("shop_orders" if name == "orders" else name)


def price_thresholds(products: DataFrame) -> DataFrame:
    """(value): prices at fixed quantiles, to the next hundred, distinct."""
    names = {f"q{i}": q for i, q in enumerate(PRICE_QUANTILES)}
    picks = stats.nearest_rank(products, "price", None, names)
    values = picks.select(F.explode(F.array(*names)).alias("p")).filter("p IS NOT NULL")
    return values.select((F.bround(F.col("p") / 100) * 100).cast("long").alias("value")).distinct()


def slot_values(shop: dict[str, DataFrame]) -> DataFrame:
    """(slot, value): the whole domains that the tables give and the fixed ones."""
    customers, products, orders = (shop[n] for n in ("customers", "products", "orders"))
    found = {
        "city": customers.select("city"),
        "segment": customers.select("segment"),
        "category": products.select("category"),
        "status": orders.select("status"),
        "product_name": products.select("name"),
        "customer_name": customers.select("name"),
        "signup_cut": orders.select(F.date_format(F.date_trunc("month", "order_date"), "yyyy-MM-dd")),
        "month": orders.select(F.date_format("order_date", "MM")),
        "price_threshold": price_thresholds(products),
    }
    out = None
    for slot, df in found.items():
        part = df.toDF("value").distinct().select(F.lit(slot).alias("slot"), F.col("value").cast("string").alias("value"))
        out = part if out is None else out.union(part)
    fixed = [(s, str(v)) for s, vs in SLOT_CONSTANTS.items() for v in vs]
    return out.union(out.sparkSession.createDataFrame(fixed, "slot string, value string"))


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, t.family, t.level, t.body, t.gold, list(t.slots), [dict(v) for v in t.variants], t.multi_row, list(t.openers)) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "pos int, family string, level string, body string, gold string, slots array<string>, variants array<map<string,string>>, multi_row boolean, openers array<string>")


def capacities(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(family, level, capacity): variants times openers times the sizes of the slots' domains."""
    sizes = values.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("sizes")).withColumn("__one", F.lit(1))
    rows = template_rows(spark).withColumn("__one", F.lit(1)).join(sizes, "__one")
    start = (F.size("variants") * F.size("openers")).cast("long")
    return rows.select("family", "level", F.aggregate("slots", start, lambda a, s: a * F.coalesce(F.col("sizes")[s], F.lit(0))).alias("capacity"))


def instances(spark: SparkSession, values: DataFrame) -> DataFrame:
    """(family, level, multi_row, body, openers, gold, slots): every variant with every combination of slot values.

    Values are joined as rows, as names grow with the tables.
    """
    out = None
    for n in sorted({len(t.slots) for t in TEMPLATES}):
        rows = template_rows(spark).filter(F.size("slots") == n).select("*", F.explode("variants").alias("filled"))
        for i in range(n):
            used = sorted({t.slots[i] for t in TEMPLATES if len(t.slots) == n})
            rows = rows.withColumn("slot", F.get("slots", F.lit(i)))
            # Templates are few whatever the tables' size.
            rows = (rows if i else F.broadcast(rows)).join(values.filter(F.col("slot").isin(*used)), "slot")
            rows = rows.withColumn("filled", F.map_concat("filled", F.create_map("slot", "value"))).drop("slot", "value")
        gold = tx.fill(F.col("gold"), F.col("filled")).alias("gold")
        part = rows.select("family", "level", "multi_row", tx.fill(F.col("body"), F.col("filled")).alias("body"), "openers", gold, F.col("filled").alias("slots"))
        out = part if out is None else out.union(part)
    return out


def enumerate_tasks(spark: SparkSession, values: DataFrame, cap: int = ENUMERATION_CAP, seed: int = 1234) -> DataFrame:
    """(family, level, multi_row, question, gold, slots): every instance, ``cap`` a family in hash order."""
    rows = instances(spark, values).withColumn("opener", F.explode("openers"))
    made = rows.select("family", "level", "multi_row", F.replace("opener", F.lit("{body}"), F.col("body")).alias("question"), "gold", "slots")
    rank = F.row_number().over(Window.partitionBy("family").orderBy(*splits.hash_order("question", seed)))
    return made.withColumn("order", rank).filter(F.col("order") <= cap)


def draw_tasks(spark: SparkSession, values: DataFrame, draws: int = 1, seed: int = 1234) -> DataFrame:
    """(family, draw, level, multi_row, question, gold, slots): ``draws`` random instances of each template.

    Draws are with replacement. Each takes a variant, an opener and the values of its
    slots by md5(seed:draw:family:what), so nothing is enumerated. A template with a
    slot of no values has no instance.
    """
    rows = template_rows(spark).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    said = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "family")

    def pick(options: str):
        drawn = F.conv(F.substring(F.md5(F.concat(said, F.lit(f":{options}"))), 1, 8), 16, 10).cast("long")
        return F.get(options, F.pmod(drawn, F.size(options)).cast("int"))

    # Templates are few whatever the tables' size.
    wanted = F.broadcast(rows.select("family", "draw", F.explode("slots").alias("slot")))
    least = F.min_by("value", F.md5(F.concat_ws(":", said, F.col("slot"), F.col("value"))))
    found = values.join(wanted, "slot").groupBy("family", "draw", "slot").agg(least.alias("value"))
    found = found.groupBy("family", "draw").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("found"))
    none = F.create_map().cast("map<string,string>")
    made = rows.join(found, ["family", "draw"], "left").withColumn("found", F.coalesce("found", none)).filter(F.size("found") == F.size("slots"))
    made = made.withColumn("filled", F.map_concat(pick("variants"), "found"))
    body = tx.fill(F.replace(pick("openers"), F.lit("{body}"), F.col("body")), F.col("filled"))
    return made.select("family", "draw", "level", "multi_row", body.alias("question"), tx.fill(F.col("gold"), F.col("filled")).alias("gold"), F.col("filled").alias("slots"))


def facts_of(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row: n_rows, all_null (the only row has nulls only) and signature of a result."""
    return exec_match.signature(df, ordered).select("n_rows", F.expr("n_rows = 1 AND n_filled = 0").alias("all_null"), "signature")


def run_golds(spark: SparkSession, golds: list[str] | DataFrame, seconds: float = exec_match.LIMIT_SECONDS, ordered: bool = True) -> DataFrame:
    """(gold, error, n_rows, all_null, signature) of distinct statements, side by side.

    A gold that fails, when analysed or when run, or takes longer than ``seconds`` has its
    error, and ``ERR:`` with it as its signature; the others don't notice. Order counts in
    signatures of golds with ORDER BY, unless ``ordered`` is off.
    """
    keys = golds.select("gold").distinct() if isinstance(golds, DataFrame) else spark.createDataFrame([(g,) for g in dict.fromkeys(golds)], "gold string")

    def facts(row) -> tuple:
        df, error = exec_match.run_sql(spark, row.gold)
        return (error, 0, False, None) if df is None else (None, *facts_of(df, ordered and exec_match.is_ordered(row.gold)).first())

    ran = exec_match.answered(keys, facts, "error string, n_rows long, all_null boolean, signature string", seconds)
    error = F.coalesce("failure", "error")
    return ran.select("gold", error.alias("error"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("all_null", F.lit(False)).alias("all_null"), F.coalesce("signature", F.concat(F.lit("ERR:"), error)).alias("signature"))


#: Slots that no table gives, in places that take no column: each value gets a statement of its own.
LITERAL_SLOTS = tuple(SLOT_CONSTANTS)
#: What a folded slot is compared as, other than text; it is the type that a literal there is cast to.
SLOT_TYPES = {"price_threshold": "long", "signup_cut": "timestamp_ntz"}
FACTS = "gold string, error string, n_rows long, all_null boolean, signature string"


def _folds(values: DataFrame) -> list[list[tuple[Template, dict[str, str], list[str]]]]:
    """(template, variant with literal slots, slots that are folded) of every statement to run, by template."""
    few: dict[str, list[str]] = {}
    for r in values.filter(F.col("slot").isin(*LITERAL_SLOTS)).collect():
        few.setdefault(r.slot, []).append(r.value)
    out = []
    for t in TEMPLATES:
        known = [s for s in t.slots if s in LITERAL_SLOTS]
        free = [s for s in t.slots if s not in LITERAL_SLOTS]
        out.append([(t, {**v, **dict(zip(known, chosen, strict=True))}, free) for v in t.variants for chosen in product(*(sorted(few.get(s, [])) for s in known))])
    return [folds for folds in out if folds]


def _of(made: DataFrame, template: Template, known: dict[str, str]) -> DataFrame:
    """The instances of one statement."""
    rows = made.filter(F.col("family") == template.family)
    for k, v in known.items():
        rows = rows.filter(F.col("slots")[k] == v)
    return rows


def _folded(made: DataFrame, template: Template, known: dict[str, str], slots: list[str]) -> DataFrame:
    """``FACTS`` of all instances of the statement, which runs once.

    Slot values are rows of a parameter table, to which the statement is joined laterally;
    the engine turns equalities into an ordinary join. What stands for a row is computed
    within the statement, so once for each of its rows and not for each value that has it.
    Results are grouped by the values.
    """
    spark = made.sparkSession
    params = _of(made, template, known).select("gold", *(F.col("slots")[x].cast(SLOT_TYPES.get(x, "string")).alias(x) for x in slots))
    text = template.gold
    for k, v in known.items():
        text = text.replace(f"{{{k}}}", v)
    if not slots:
        one = F.lit(1).alias("__one")  # one row on each side
        return params.select("gold", one).join(facts_of(spark.sql(text)).select("*", one), "__one").select("gold", F.lit(None).cast("string").alias("error"), "n_rows", "all_null", "signature")
    view = f"fold_{uuid.uuid4().hex}"
    params.select(*slots).createOrReplaceTempView(view)
    for x in slots:
        text = text.replace(f"'{{{x}}}'", f"p.{x}").replace(f"{{{x}}}", f"p.{x}")
    try:
        schema = spark.sql(f"SELECT r.* FROM {view} p, LATERAL ({text}) r").schema
        cells = [f"c{i}" for i in range(len(schema))]
        normal = ", ".join(f"{exec_match.normal_cell(StructField(c, f.dataType))} AS {c}" for c, f in zip(cells, schema, strict=True))
        rows = f"SELECT {exec_match.row_number_of(cells)} AS number, {exec_match.filled(cells)} AS filled FROM (SELECT {normal} FROM ({text}) AS t({', '.join(cells)}))"
        found = spark.sql(f"SELECT p.*, r.* FROM {view} p, LATERAL ({rows}) r")
        found._jdf.queryExecution().optimizedPlan()  # what cannot be folded is refused here
    finally:
        spark.catalog.dropTempView(view)
    keys = [f"k{i}" for i in range(len(slots))]
    found = found.toDF(*keys, "number", "filled")
    sums = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("some"), exec_match.total_of(F.col("number")).alias("total"))
    met = params.toDF("gold", *keys).join(sums, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return met.select("gold", F.lit(None).cast("string").alias("error"), n.alias("n_rows"), ((n == 1) & (F.coalesce("some", F.lit(0)) == 0)).alias("all_null"), F.coalesce("total", F.lit("0")).alias("signature"))


def folded_golds(spark: SparkSession, values: DataFrame, seconds: float = exec_match.LIMIT_SECONDS) -> DataFrame:
    """``run_golds`` of every instance of every template, by one statement for each template,
    variant and literal slot value; signatures are of results without their order.

    A template's statements are one job, where they share what they have in common. It
    may take ``seconds`` for each instance, as these might singly. Statements of a job that
    fails run as jobs of their own; one that the engine cannot fold, or that fails for one of
    its values, is run singly for each of them, so failures are those of the instances that fail.
    """
    path = scratch_path(spark, "golds")
    instances(spark, values).select("family", "gold", "slots").write.partitionBy("family").parquet(f"{path}-made")
    made = spark.read.schema("gold string, slots map<string,string>, family string").parquet(f"{path}-made")
    sizes = {r.family: r["count"] for r in made.groupBy("family").count().collect()}
    spark.createDataFrame([], FACTS).write.parquet(path)

    def run(folds: list) -> str:
        to = scratch_path(spark, "golds")  # another one each time: what ran out of time leaves a folder
        reduce(DataFrame.union, (_folded(made, *f) for f in folds)).write.parquet(to)
        return to

    done, singly, jobs = [path], [], [folds for folds in _folds(values) if folds[0][0].family in sizes]
    while jobs:
        ran = exec_match.side_by_side(spark, jobs, run, lambda folds: seconds * sizes[folds[0][0].family])
        done += [to for to, error in ran if error is None]
        failed = [folds for folds, (_, error) in zip(jobs, ran, strict=True) if error is not None]
        singly += [folds[0] for folds in failed if len(folds) == 1]
        jobs = [[f] for folds in failed if len(folds) > 1 for f in folds]
    out = spark.read.schema(FACTS).parquet(*done)
    if singly:
        left = reduce(DataFrame.union, (_of(made, template, known) for template, known, _ in singly))
        out = out.union(run_golds(spark, left, seconds, ordered=False))
    return out


def validated(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    """``tasks`` with their gold's facts and ``reason``: why a task is no use, or ``ok``."""
    reason = (
        F.when(~F.lower(F.ltrim("gold")).startswith("select"), "not_select")
        .when(F.col("error").isNotNull(), F.concat(F.lit("gold_error:"), "error"))
        .when(F.col("n_rows").isNull(), "gold_none")
        .when(F.col("n_rows") == 0, "empty_result")
        .when(F.col("all_null"), "all_null_result")
        .when(F.col("multi_row") & (F.col("n_rows") < 2), "degenerate_single_row")
        .otherwise("ok")
    )
    return tasks.join(facts, "gold", "left").withColumn("reason", reason)


def corpus(tasks: DataFrame) -> DataFrame:
    """The accepted tasks (reason ok, no rejecting rule), the first of each question in a family."""
    fine = tasks.filter("reason = 'ok' AND (rule IS NULL OR rule = 'signature_only')")
    rank = F.row_number().over(Window.partitionBy("family", tx.norm_question(F.col("question"))).orderBy("order"))
    return fine.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def audit_counts(tasks: DataFrame) -> DataFrame:
    """(family, why, n): rejections by family and reason, with totals (null keys)."""
    why = F.when(F.col("reason") != "ok", F.col("reason")).otherwise(F.coalesce("rule", F.lit("accepted")))
    return tasks.withColumn("why", why).cube("family", "why").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Splits:
    train: DataFrame
    val: DataFrame
    test_ext: DataFrame
    requested: dict[str, int] = field(default_factory=dict)

    def summary(self) -> dict[str, dict[str, int]]:
        made = {n: getattr(self, n).count() for n in ("train", "val", "test_ext")}
        return {"requested": self.requested, "produced": made, "shortfall": {n: self.requested[n] - k for n, k in made.items()}}


def make_splits(accepted: DataFrame, n_train: int = 800, n_val: int = 200, n_ext: int = 200, exclude: tuple[str, ...] = (), seed: int = 1234) -> Splits:
    """Reserve test_ext from the held-out patterns, then deal train and val from the rest by level."""
    accepted = cut(accepted.withColumn("key", F.sha1(F.concat_ws("\x1f", "family", tx.norm_question(F.col("question"))))))
    pool = accepted.filter(F.col("family").isin(*TEST_FAMILIES))
    ext = splits.allocate(pool, min(n_ext, int(pool.count() * RESERVED_SHARE)), LEVEL_MIX, "family", "level", "key", seed + 1)
    rest = accepted.join(ext.select("key"), "key", "left_anti")
    rest = rest.filter(~F.col("family").isin(*exclude)) if exclude else rest
    both = splits.allocate(rest, n_train + n_val, LEVEL_MIX, "family", "level", "key", seed + 2)
    dealt = cut(splits.stratified_split(both, n_val / max(n_train + n_val, 1), "level", "key", seed + 3))

    def numbered(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*splits.hash_order("key", seed + 4)))  # a split's size is asked for
        return df.withColumn("split", F.lit(name)).withColumn("id", F.format_string(f"{name[:2]}%04d", place))

    parts = {n: numbered(dealt.filter(F.col("split") == n), n) for n in ("train", "val")}
    return Splits(parts["train"], parts["val"], numbered(ext, "test_ext"), {"train": n_train, "val": n_val, "test_ext": n_ext})


def to_json(report: dict) -> str:
    return json.dumps(report, sort_keys=True, indent=1)
