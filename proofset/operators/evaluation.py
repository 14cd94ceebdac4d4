"""Evaluation records and their accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.functions import stats
from proofset.functions import text as tx
from proofset.functions.ordered import running
from proofset.operators.exec_match import ERROR_KINDS, GoldError, Matcher, constant, run_rows, side_by_side

RECORD = "id string, level string, question string, gold string, pred string, error string, correct boolean"

# ---- Fixed values: prices in dollars ------------------------------------------
TOKEN_PRICES = {"4o-mini": (0.15, 0.60), "4o": (2.50, 10.00), "4.1-mini": (0.40, 1.60)}  # a million tokens in, out
GPU_HOUR = {"T4": 0.35, "L4": 0.70, "A10G": 1.00, "A100-40GB": 2.00}
# --------------------------------------------------------------------------------


def evaluate(spark: SparkSession, tasks: list[dict], agent: Callable[[str], str], matcher: Matcher | None = None) -> DataFrame:
    """Records of an agent over a bounded list of tasks (id, level, question, gold).

    The agent's crash is an answer that fails, as is a statement that fails or takes too
    long; a gold that fails is told in ``error``, and nothing is correct against it.
    Statements are judged side by side.
    """
    matcher = matcher or Matcher(spark)
    preds = []
    for task in tasks:
        try:
            preds.append(tx_statement(agent(task["question"])))
        except Exception as e:  # the agent's own failure is a result
            preds.append(f"-- agent error: {type(e).__name__}")

    def judged(pair: tuple[dict, str]) -> tuple[str | None, bool]:
        try:
            info = matcher.info(pair[1], pair[0]["gold"])
        except GoldError as e:
            return f"gold_error: {e}", False
        return None if pair[1].startswith("-- agent error") else info.error, info.correct

    ran = side_by_side(spark, zip(tasks, preds, strict=True), judged, 4 * matcher.seconds, told=lambda r: r[0])
    found = [r if failure is None else (failure, False) for r, failure in ran]
    rows = [(str(t["id"]), t["level"], t["question"], t["gold"], p, *f) for t, p, f in zip(tasks, preds, found, strict=True)]
    return spark.createDataFrame(rows, RECORD)


def evaluate_batches(spark: SparkSession, tasks: list[dict], agent: Callable[[list[str]], list[str]], size: int = 16, repairs: int = 0, repair: Callable[[list[tuple[str, str, str]]], list[str]] | None = None) -> DataFrame:
    """As ``evaluate`` with batched agents: a failed batch fails all its tasks, missing answers are empty.

    ``repair`` gets (question, statement, error) of the answers that raise errors, never
    of those that merely are wrong, for up to ``repairs`` rounds.
    """
    answers: list[str] = []
    for lo in range(0, len(tasks), size):
        batch = tasks[lo : lo + size]
        try:
            got = [tx_statement(a) for a in agent([t["question"] for t in batch])][: len(batch)]
        except Exception as e:
            got = [f"-- agent error: {type(e).__name__}"] * len(batch)
        answers += got + [""] * (len(batch) - len(got))
    for _ in range(repairs if repair else 0):
        failed = [(i, e) for i, (_, e) in enumerate(run_rows(spark, a, 1) for a in answers)]
        failed = [(i, e) for i, e in failed if e is not None]
        if not failed:
            break
        for (i, _), new in zip(failed, repair([(tasks[i]["question"], answers[i], e) for i, e in failed]), strict=False):
            answers[i] = tx_statement(new)
    given = iter(answers)
    return evaluate(spark, tasks, lambda _: next(given))


def tx_statement(text: str | None) -> str:
    """``extract_statement`` for one string."""
    spark = SparkSession.active()
    return constant(spark, tx.extract_statement(F.lit(text).cast("string")).alias("s")).s


def correctness_vector(records: DataFrame, key: str = "id", correct: str = "correct") -> DataFrame:
    """(key, hit): 0 or 1 for each record, ordered by key, so that two runs can be paired."""
    return records.select(key, F.col(correct).cast("int").alias("hit")).orderBy(key)


def by_level(records: DataFrame, level: str = "level", correct: str = "correct") -> DataFrame:
    """Per level and in all (level null): correct, n, accuracy."""
    hit = F.col(correct).cast("int")
    return records.rollup(level).agg(F.sum(hit).alias("correct"), F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def with_interval(df: DataFrame, k: str = "correct", n: str = "n") -> DataFrame:
    low, high = stats.wilson(F.col(k), F.col(n))
    return df.withColumns({"low": low, "high": high})


def error_kind(correct: Column, pred: Column, error: Column) -> Column:
    """Why a record failed; null if it did not."""
    text = F.trim(F.coalesce(pred, F.lit("")))
    kind = F.regexp_extract(F.coalesce(error, F.lit("")), r"^([A-Z_]+)", 1)
    known = F.create_map(*(F.lit(x) for kv in ERROR_KINDS.items() for x in kv))
    return (
        F.when(correct, None)
        .when(text == "", "empty_output")
        .when(F.startswith(text, F.lit("-- agent error")), "agent_crashed")
        .when(~tx.looks_like_select(text), "not_a_select")
        .when(error.isNull(), "ran_but_wrong")
        .otherwise(F.coalesce(known[kind], F.lit("other_sql_error")))
    )


def error_taxonomy(records: DataFrame) -> DataFrame:
    kinds = records.select(error_kind(F.col("correct"), F.col("pred"), F.col("error")).alias("kind")).filter("kind IS NOT NULL")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def robustness(records: DataFrame, kind: str = "kind", correct: str = "correct") -> DataFrame:
    return records.groupBy(kind).agg(F.avg(F.coalesce(F.col(correct).cast("int"), F.lit(0))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cost_per_model(calls: DataFrame, model: str, tokens_in: str, tokens_out: str, prices: dict[str, tuple[float, float]] = TOKEN_PRICES) -> DataFrame:
    """Calls, tokens and dollars per model; an unknown model costs nothing."""
    table = lambda i: F.create_map(*(F.lit(x) for m, p in prices.items() for x in (m, p[i])))
    summed = calls.groupBy(model).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    price = lambda i: F.coalesce(table(i)[F.col(model)], F.lit(0.0))
    return summed.withColumn("cost", F.col("tokens_in") / 1e6 * price(0) + F.col("tokens_out") / 1e6 * price(1))


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens a second; 0 without time."""
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)


def serving_costs(df: DataFrame, gpu_hour: str, per_second: str, api_per_1k: str) -> DataFrame:
    """``df`` with own cost per 1000 queries, and queries a second at which it equals the API's."""
    own = F.col(gpu_hour) / (F.col(per_second) * 3600) * 1000
    return df.withColumns({"own_per_1k": own, "break_even_qps": F.col(gpu_hour) / (F.col(api_per_1k) / 1000 * 3600)})


def efficiency(df: DataFrame) -> DataFrame:
    """One row over trajectories (calls, tool_calls, tokens, latency, truncated, correct)."""
    means = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("calls").alias("mean_calls"),
        F.avg("tool_calls").alias("mean_tool_calls"),
        F.avg("tokens").alias("mean_tokens"),
        F.avg(F.col("truncated").cast("int")).alias("truncated_frac"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )
    ranks = stats.nearest_rank(df, "latency", None, {"p50": 0.5, "p95": 0.95}).drop("n")
    return means.withColumn("__one", F.lit(1)).join(ranks.withColumn("__one", F.lit(1)), "__one").drop("__one")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: tp, tn, fp, fn and agreement of two 0/1 columns."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(
        count(a & p).alias("tp"), count(~a & ~p).alias("tn"), count(~a & p).alias("fp"), count(a & ~p).alias("fn"),
        F.avg((a == p).cast("int")).alias("agreement"),
    )


def complementarity(df: DataFrame, agent: str, item: str, correct: str) -> DataFrame:
    """For each pair of agents: items only the one, only the other, both and neither get right.

    Agents are few; items meet on their id.
    """
    a = df.select(F.col(item).alias("i"), F.col(agent).alias("a"), F.col(correct).cast("int").alias("x"))
    b = a.toDF("i", "b", "y")
    count = lambda c: F.count(F.when(c, 1))
    return a.join(b, "i").filter("a < b").groupBy("a", "b").agg(
        count(F.expr("x > y")).alias("only_a"), count(F.expr("y > x")).alias("only_b"),
        count(F.expr("x = 1 AND y = 1")).alias("both"), count(F.expr("x = 0 AND y = 0")).alias("neither"),
    )


def heatmap(df: DataFrame, agent: str, item: str, correct: str, agents: list[str]) -> DataFrame:
    """A row per item with a 0/1 column per agent."""
    return df.groupBy(item).pivot(agent, agents).agg(F.max(F.col(correct).cast("int")))


def pareto(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows that no other beats on cost and value at once: a running best over rising cost.

    Costs are grouped first; the best value of each cost meets the best before it.
    """
    best = df.groupBy(F.col(cost).alias("__c")).agg(F.max(value).alias("__v"))
    front = running(best, ["__c"], best="__v").filter("__before IS NULL OR __v > __before")
    return df.join(front, (F.col(cost) == F.col("__c")) & (F.col(value) == F.col("__v"))).drop("__c", "__v", "__before")


def same_decisions(a: DataFrame, b: DataFrame, item: str, correct: str) -> DataFrame:
    """One row: the items on which two evaluations differ (missing ones too)."""
    x = a.select(item, F.col(correct).cast("int").alias("x"))
    y = b.select(item, F.col(correct).cast("int").alias("y"))
    met = x.join(y, item, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    return met.agg(F.count(F.lit(1)).alias("n_different"))
