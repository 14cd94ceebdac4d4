"""Rewards as column expressions over execution facts and completions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.functions import text as tx

# ---- Fixed values: weights, bounds and thresholds ---------------------------
REWARD_MIN, REWARD_MAX = -0.20, 1.35
PROXY_EXECUTES, PROXY_ROWS, PROXY_OVERLAP, PROXY_MOST_ROWS = 0.4, 0.3, 0.3, 50
COLLAPSE_SHARE = 0.30
MOST_STEPS = 3
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    exec_match: float = 1.00
    format: float = 0.15
    executes: float = 0.10
    nonempty: float = 0.05
    efficiency: float = 0.05  # taken off for each further call

    def bounds(self) -> dict[str, float | bool]:
        """How far apart correct and incorrect answers score.

        The worst correct answer has a bad format and took ``MOST_STEPS`` further calls;
        the best incorrect one has a good format, runs at once and returns rows.
        """
        least = self.exec_match + self.executes + self.nonempty - MOST_STEPS * self.efficiency
        most = self.format + self.executes + self.nonempty
        return {"min_correct": least, "max_incorrect": most, "margin": least - most, "separated": least > most}


def efficiency(calls: Column) -> Column:
    return F.greatest(calls - 1, F.lit(0)).cast("double")


def shape_score(n_cols: Column, n_rows: Column, gold_cols: Column, gold_rows: Column, executes: Column) -> Column:
    """Half for the right number of columns, half for the right number of rows."""
    half = lambda hit: F.when(hit, 0.5).otherwise(0.0)
    return F.when(executes, half(n_cols == gold_cols) + half(n_rows == gold_rows)).otherwise(0.0)


def components(df: DataFrame) -> DataFrame:
    """``df`` (completion, executes, n_rows, correct, calls) with one column per component."""
    flag = lambda c: c.cast("double")
    sql = tx.extract_statement(F.col("completion"))
    return df.withColumns(
        {
            "r_exec_match": flag(F.col("correct")),
            "r_format": tx.format_score(F.col("completion")),
            "r_executes": flag(F.col("executes")),
            "r_nonempty": flag(F.col("executes") & (F.col("n_rows") > 0)),
            "r_safety": flag(tx.is_read_only(sql)),
            "r_efficiency": efficiency(F.col("calls")),
            "unsafe": flag(tx.is_write(sql)),
        }
    )


def composite(df: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``components`` and ``reward``; a write statement never scores above 0."""
    rows = components(df)
    total = (
        F.col("r_exec_match") * weights.exec_match
        + F.col("r_format") * weights.format
        + F.col("r_executes") * weights.executes
        + F.col("r_nonempty") * weights.nonempty
        - F.col("r_efficiency") * weights.efficiency
    )
    total = F.when(F.col("unsafe") > 0, F.least(total, F.lit(0.0))).otherwise(total)
    return rows.withColumn("reward", F.greatest(F.lit(REWARD_MIN), F.least(F.lit(REWARD_MAX), total)))


def reward_parts(df: DataFrame) -> Column:
    """The components as a map."""
    names = [c for c in df.columns if c.startswith("r_")]
    return F.create_map(*(x for n in names for x in (F.lit(n[2:]), F.col(n))))


def proxy(df: DataFrame) -> DataFrame:
    """``df`` (completion, question, executes, n_rows) with the gold-free ``proxy`` reward."""
    sql = tx.extract_statement(F.col("completion"))
    ran = F.when(F.col("executes"), PROXY_EXECUTES + F.when(F.col("n_rows").between(1, PROXY_MOST_ROWS), PROXY_ROWS).otherwise(0.0)).otherwise(0.0)
    score = F.least(F.lit(1.0), ran + PROXY_OVERLAP * tx.overlap(sql, F.col("question")))
    return df.withColumn("proxy", F.when(sql == "", 0.0).otherwise(score))


def hack_flags(sql: Column) -> dict[str, Column]:
    """The shapes of degenerate statements."""
    low = F.lower(sql)
    some = low != ""
    return {
        "empty": ~some,
        "no_from_clause": some & ~F.contains(low, F.lit(" from ")),
        "select_star": some & low.rlike(r"select\s+\*"),
        "degenerate_limit": some & low.rlike(r"\blimit\s+1\b") & ~F.contains(low, F.lit("order by")),
        "no_where_no_join": some & ~F.contains(low, F.lit(" where ")) & ~F.contains(low, F.lit(" join ")),
    }


def hack_report(completions: DataFrame) -> DataFrame:
    """One row over ``completions`` (completion): flag counts, the most common statement and its share."""
    sql = tx.extract_statement(F.col("completion"))
    rows = completions.select(sql.alias("sql"))
    flags = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(n) for n, c in hack_flags(F.col("sql")).items()))
    keyed = rows.filter("sql <> ''").groupBy(tx.dedup_key(F.col("sql")).alias("key")).agg(F.count(F.lit(1)).alias("times"))
    mode = keyed.agg(F.count(F.lit(1)).alias("distinct_sql"), F.min(F.struct((-F.col("times")).alias("t"), "key")).alias("top"))
    # One row each.
    out = flags.withColumn("__one", F.lit(1)).join(mode.withColumn("__one", F.lit(1)), "__one")
    times = F.coalesce(-F.col("top.t"), F.lit(0))
    share = times / F.greatest(F.col("n"), F.lit(1))
    return out.select(
        *flags.columns,
        F.col("distinct_sql"),
        F.substring(F.coalesce("top.key", F.lit("")), 1, 120).alias("most_common_sql"),
        F.round(share, 3).alias("most_common_frac"),
        F.when(share > COLLAPSE_SHARE, times).otherwise(0).cast("long").alias("answer_collapse"),
        ((share > COLLAPSE_SHARE) | (F.col("no_from_clause") > 0)).alias("suspicious"),
    )
