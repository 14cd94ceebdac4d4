from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofset.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "statement"),
    [
        ("```sql\nSELECT 1;\n```", "SELECT 1;"),
        ("```\nSELECT 2\n```", "SELECT 2"),
        ("SQL: SELECT 3", "SELECT 3"),
        ("SELECT 4; SELECT 5", "SELECT 4;"),
        ("", ""),
        (None, ""),
        ("Sure:\n```SQL select 6```\nDone.", "select 6"),
        ("  SELECT 7  ", "SELECT 7"),
    ],
)
def test_extract_statement(spark, text, statement):
    assert value(spark, tx.extract_statement(F.lit(text).cast("string"))) == statement


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("```sql\nSELECT 1\n```", 1.0),
        ("ok ```SELECT 1```", 1.0),
        ("x" * 41 + "```SELECT 1```", 0.5),
        ("SELECT 1", 0.0),
        ("```a``` ```b```", 0.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_format_score(spark, text, score):
    assert value(spark, tx.format_score(F.lit(text).cast("string"))) == score


@pytest.mark.parametrize(
    ("sql", "write", "read_only"),
    [
        ("SELECT 1", False, True),
        ("(SELECT 1)", False, True),
        ("with x as (select 1) select * from x;", False, True),
        ("SELECT 1; DROP TABLE t", True, False),
        ("drop table t", True, False),
        ("updated things", True, False),  # a prefix is enough
        ("hello", False, False),
        ("SELECT a FROM t WHERE b = ' delete '", False, False),
        ("SELECT 1; SELECT 2", False, False),
    ],
)
def test_guards(spark, sql, write, read_only):
    assert value(spark, tx.is_write(F.lit(sql))) is write
    assert value(spark, tx.is_read_only(F.lit(sql))) is read_only


def test_a_write_far_behind_is_flagged(spark):
    assert value(spark, tx.is_write(F.concat(F.repeat(F.lit("SELECT 1;"), 10_005), F.lit("DROP TABLE t")))) is True
    assert value(spark, tx.is_write(F.repeat(F.lit("SELECT 1;"), 10_005))) is False
    assert value(spark, tx.is_write(F.lit(None).cast("string"))) in (None, False)


def test_questions(spark):
    assert value(spark, tx.norm_question(F.lit("  What's the  'Total', élan_2? "))) == "whats the total élan_2"
    assert value(spark, tx.content_tokens(F.lit("How many orders, orders of 2025?"))) == ["orders"]
    empty = F.array().cast("array<string>")
    assert value(spark, tx.jaccard(empty, empty)) == 1.0
    assert value(spark, tx.jaccard(F.array(F.lit("a")), empty)) == 0.0
    assert value(spark, tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_canonical_sql(spark):
    a = "SELECT c.name AS n FROM customers c  JOIN orders o ON o.id = c.id;"
    b = "select x.name from customers x join orders y on y.id = x.id"
    assert value(spark, tx.canonical_sql(F.lit(a))) == value(spark, tx.canonical_sql(F.lit(b)))


def test_perturbations(spark):
    q = "List the names of all customers who ordered products, products again"
    assert value(spark, tx.paraphrase(F.lit(q))) == "Give me every clients who ordered items, products again"
    assert value(spark, tx.rename(F.lit("Customer orders by category"))) == "buyers purchases by product group"
    assert value(spark, tx.distractor(F.lit("x "), F.lit(3))).startswith("x ")
    slipped = value(spark, tx.typo(F.lit("find several wonderful 'quoted' things"), F.lit(5)))
    assert slipped != "find several wonderful 'quoted' things" and "'quoted'" in slipped
    assert sum(a != b for a, b in zip(slipped.split(), "find several wonderful 'quoted' things".split(), strict=True)) <= 2


def test_tool_calls_and_prompts(spark):
    good = value(spark, tx.tool_call(F.lit('<tool>{"name": "run_query", "args": {"sql": "SELECT 1"}}</tool>')))
    assert good.name == "run_query" and good.args == {"sql": "SELECT 1"}
    assert value(spark, tx.tool_call(F.lit("<tool>{bad}</tool>"))).name == "__bad_json__"
    assert value(spark, tx.tool_call(F.lit("SELECT 1"))) is None
    messages = value(spark, tx.prompt(F.lit("How many?"), "t(a int)"))
    assert [m.role for m in messages] == ["system", "user"] and messages[1].content.endswith("How many?")
    assert "Error: boom" in value(spark, tx.repair_prompt(F.lit("q"), "t", F.lit("SELECT"), F.lit("boom")))[1].content
    assert value(spark, tx.fill(F.lit("a {x} b {y}"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")))) == "a 1 b 2"
    steps = F.array(F.struct(F.lit("user").alias("role"), F.lit("y" * 700).alias("content")))
    assert value(spark, tx.render_steps(steps)) == "[user]\n" + "y" * 600
