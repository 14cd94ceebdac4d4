"""Training sets from sampled completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.functions import text as tx
from proofset.operators.contamination import first_by_key


def rejection_sample(df: DataFrame, task: str, correct: str, sql: str, position: str, shortest: bool = True) -> DataFrame:
    """One kept completion per task with a correct one: the shortest, or else the first.

    Columns: task, sql, n_correct_of_k, k.
    """
    order = [F.length(sql).alias("n")] if shortest else []
    best = F.min(F.when(F.col(correct), F.struct(*order, F.col(position).alias("p"), F.col(sql).alias("sql"))))
    kept = df.groupBy(task).agg(best.alias("best"), F.count(F.when(F.col(correct), 1)).alias("n_correct_of_k"), F.count(F.lit(1)).alias("k"))
    return kept.filter("best IS NOT NULL").select(task, F.col("best.sql").alias("sql"), "n_correct_of_k", "k")


def first_candidate(df: DataFrame, task: str, sql: str, position: str) -> DataFrame:
    """The unfiltered arm: each task's first completion, right or wrong."""
    return df.groupBy(task).agg(F.min_by(sql, position).alias("sql"))


def yield_by_level(df: DataFrame, task: str, level: str, correct: str) -> DataFrame:
    """Per level: tasks with a kept completion over all tasks."""
    solved = df.groupBy(level, task).agg(F.max(F.col(correct).cast("int")).alias("hit"))
    return solved.groupBy(level).agg(F.sum("hit").alias("kept"), F.count(F.lit(1)).alias("tasks")).withColumn("yield", F.round(F.col("kept") / F.col("tasks"), 3))


def dedup_by_sql(df: DataFrame, sql: str, position: str) -> DataFrame:
    return first_by_key(df, tx.dedup_key(F.col(sql)), position)


def arms(kept: DataFrame, unfiltered: DataFrame, clean: DataFrame, task: str, seed: int = 1234) -> DataFrame:
    """The three arms on an equal budget, the size of the smallest, in hash order."""
    budget = min(f.count() for f in (kept, unfiltered, clean))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(task).cast("string")))
    named = [f.select(task, "sql").orderBy(order, task).limit(budget).withColumn("arm", F.lit(n)) for f, n in ((kept, "filtered"), (unfiltered, "unfiltered"), (clean, "no_leak"))]
    return named[0].union(named[1]).union(named[2])


def sft_rows(df: DataFrame, schema: str) -> DataFrame:
    """(question, sql, ...) as prompt and completion message arrays."""
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("```sql\n"), F.col("sql"), F.lit("\n```")).alias("content")))
    return df.withColumns({"prompt": tx.prompt(F.col("question"), schema), "completion": answer})


def grpo_rows(df: DataFrame, schema: str) -> DataFrame:
    """(question, gold, ...) with the prompt alone."""
    return df.withColumn("prompt", tx.prompt(F.col("question"), schema))
