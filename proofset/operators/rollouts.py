"""Rollouts of a policy over tables of tasks, turn by turn.

A policy is a function of two columns, the messages so far and the member's number in
its group, to a column of texts: a Pandas UDF around a model, or any expression. All open
episodes take a turn together, so a rollout of any number of tasks is as many passes as
there are turns. Tool calls and final statements need a session: distinct ones run side
by side, in slices, with a time limit each, and their answers are joined as rows.

Tasks have (id, question, gold) and any other columns.

Defined results
    null text of a policy     counts as the empty text: malformed, or at last no statement
    a call that fails         its error is the tool's answer
    a gold that fails         ``gold_error`` says so; nothing is correct against it
    repeated ids, no tasks    episodes are rows, not ids; an empty table
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.functions import text as tx
from proofset.operators import exec_match, rewards
from proofset.operators.trajectories import CORRECTION, MAX_TURNS, Tools
from proofset.sources.records import cut

Policy = Callable[[Column, Column], Column]


def _grouped(tasks: DataFrame, size: int) -> DataFrame:
    """``size`` members of each task, numbered from 0."""
    return tasks.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))


def _said(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def single_turn(tasks: DataFrame, policy: Policy, schema: str, size: int = 1) -> DataFrame:
    """One answer for each member: steps, completion, final_sql, turns, tool_calls, reason."""
    asked = _grouped(tasks, size).withColumn("steps", tx.prompt(F.col("question"), schema))
    said = cut(asked.withColumn("completion", F.coalesce(policy(F.col("steps"), F.col("member")), F.lit(""))))
    return said.withColumns(
        {
            "steps": F.concat("steps", _said("assistant", F.col("completion"))),
            "final_sql": tx.extract_statement(F.col("completion")),
            "turns": F.lit(1),
            "tool_calls": F.lit(0),
            "reason": F.lit("single_turn"),
        }
    )


def multi_turn(tasks: DataFrame, policy: Policy, schema: str, tools: Tools, size: int = 1, max_turns: int = MAX_TURNS, hide_schema: bool = False) -> DataFrame:
    """As ``single_turn``; a member may call tools, and is corrected, until it submits or its turns end."""
    prompt = tx.tool_prompt(F.col("question"), None if hide_schema else schema, max_turns)
    running = cut(_grouped(tasks, size).withColumns({"steps": prompt, "tool_calls": F.lit(0)}))
    ended = None
    for turn in range(1, max_turns + 1):
        text = F.coalesce(policy(F.col("steps"), F.col("member")), F.lit(""))
        said = running.withColumns({"completion": text, "turns": F.lit(turn)})
        said = said.withColumns({"raw": F.regexp_extract("completion", tx.TOOL_CALL, 1), "call": tx.tool_call(F.col("completion")), "final_sql": tx.extract_statement(F.col("completion"))})
        called = F.col("call").isNotNull()
        submits = ~called & tx.looks_like_select(F.col("final_sql"))
        said = cut(said.withColumns({"steps": F.concat("steps", _said("assistant", F.col("completion"))), "called": called, "submits": submits, "tool_calls": F.col("tool_calls") + called.cast("int")}))
        last = turn == max_turns
        answers = tools.answered(said.filter("called").select("raw", "call"))
        said = said.join(answers, "raw", "left").withColumn("steps", F.when(F.col("called"), F.concat("steps", _said("tool", F.col("said")))).otherwise(F.col("steps")))
        reason = F.when(F.col("submits"), "submitted").when(F.col("called"), "max_turns").otherwise("malformed_final")
        out = said if last else said.filter("submits")
        out = out.withColumns({"reason": reason, "final_sql": F.when(F.col("submits"), F.col("final_sql")).otherwise("")}).drop("raw", "call", "called", "submits", "said")
        ended = out if ended is None else ended.unionByName(out)
        if not last:
            reply = F.when(F.col("called"), F.col("steps")).otherwise(F.concat("steps", _said("tool", F.lit(CORRECTION))))
            running = cut(said.filter("NOT submits").withColumn("steps", reply).select(*running.columns))
    return ended


def scored(episodes: DataFrame, matcher: exec_match.Matcher, weights: rewards.Weights = rewards.Weights()) -> DataFrame:
    """``episodes`` with executes, n_rows, error, gold_error, correct, the components, and reward.

    Each distinct pair of statement and gold runs once. An episode that ended without an
    answer is judged by its last text, and never correct.
    """
    rows = episodes.withColumn("sql", tx.extract_statement(F.col("completion")))

    def facts(pair) -> tuple:
        try:
            info = matcher.info(pair.sql, pair.gold)
        except exec_match.GoldError as e:
            return False, 0, None, str(e), False
        return info.executes, info.n_rows, info.error, None, info.correct

    found = exec_match.answered(rows.select("sql", "gold").distinct(), facts, "executes boolean, n_rows long, error string, gold_error string, correct boolean", 4 * matcher.seconds, told=lambda r: r[2] or r[3])
    late = F.coalesce("error", "failure")
    found = found.select("sql", "gold", F.coalesce("executes", F.lit(False)).alias("executes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), late.alias("error"), "gold_error", F.coalesce("correct", F.lit(False)).alias("correct"))
    judged = rows.join(found, ["sql", "gold"], "left").withColumn("correct", F.col("correct") & (F.col("final_sql") != ""))
    return rewards.composite(judged.withColumn("calls", F.col("turns")), weights).drop("sql", "calls")
