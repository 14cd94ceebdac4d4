"""Groups of sampled trajectories and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofset.functions import text as tx
from proofset.operators import exec_match

# ---- Fixed values ------------------------------------------------------------
EPSILON = 1e-4
BAND = (0.125, 0.875)
REFUSAL = "refused: only read-only queries run here"
CORRECTION = "Neither a tool call nor a statement was found. Reply with one of them."
UNKNOWN_CALL = "no result is known for this call"
MAX_TURNS, ROWS_SHOWN = 4, 10
# ------------------------------------------------------------------------------


def advantages(df: DataFrame, group: str, reward: str, scale: bool = True) -> DataFrame:
    """``df`` with ``advantage``: reward less the group's mean, over its deviation; 0 for flat groups.

    Moments are aggregated and joined back instead of windowed, so that a large group
    is combined before the shuffle.
    """
    moments = df.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))
    centred = F.col(reward) - F.col("__mean")
    value = F.when(F.col("__std") < EPSILON, 0.0).otherwise(centred / (F.col("__std") + EPSILON)) if scale else centred
    return df.join(moments, group).withColumn("advantage", value).drop("__mean", "__std")


def group_summary(df: DataFrame, group: str, reward: str, correct: str, position: str, turns: str | None = None, tool_calls: str | None = None) -> DataFrame:
    """Per group: size, reward moments and range, pass rate, pass at 1 (the first member) and at G,
    and the means of turns and tool calls where those columns are named."""
    hit = F.col(correct).cast("int")
    means = [F.avg(c).alias(n) for c, n in ((turns, "mean_turns"), (tool_calls, "mean_tool_calls")) if c]
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("g"),
        F.avg(reward).alias("reward_mean"),
        F.stddev_pop(reward).alias("reward_std"),
        F.min(reward).alias("reward_min"),
        F.max(reward).alias("reward_max"),
        F.avg(hit).alias("pass_rate"),
        F.min_by(hit, position).alias("pass_at_1"),
        F.max(hit).alias("pass_at_g"),
        (F.stddev_pop(reward) < EPSILON).alias("zero_advantage"),
        *means,
    )


def learnable_band(df: DataFrame, group: str, correct: str, lo: float = BAND[0], hi: float = BAND[1]) -> DataFrame:
    """Groups whose pass rate lies in the band, both ends included."""
    rates = df.groupBy(group).agg(F.avg(F.col(correct).cast("int")).alias("pass_rate"))
    return rates.filter(F.col("pass_rate").between(lo, hi))


def probe_band(df: DataFrame, group: str, correct: str, probes: int, lo: float = BAND[0], hi: float = BAND[1]) -> DataFrame:
    """As ``learnable_band``, over a fixed number of probes, however many came back."""
    rates = df.groupBy(group).agg((F.sum(F.col(correct).cast("int")) / F.lit(probes)).alias("probe_rate"))
    return rates.filter(F.col("probe_rate").between(lo, hi))


def pass_at_k(df: DataFrame, group: str, correct: str, position: str, k: int | None = None) -> DataFrame:
    """One row: the share of groups with a success among the first ``k`` members."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(position))
    rows = df if k is None else df.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    hits = rows.groupBy(group).agg(F.max(F.col(correct).cast("int")).alias("hit"))
    return hits.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("pass_at_k"))


def zero_advantage_fraction(df: DataFrame, group: str, reward: str) -> DataFrame:
    """One row: the share of groups whose rewards, to six places, are all the same."""
    flat = df.groupBy(group).agg((F.countDistinct(F.round(reward, 6)) <= 1).cast("int").alias("flat"))
    return flat.agg(F.coalesce(F.avg("flat"), F.lit(0.0)).alias("zero_advantage_fraction"))


# ---- Conversations: (conv_id, turn, role, text) ------------------------------


def episode_pairs(turns: DataFrame) -> DataFrame:
    """A row per assistant turn: the messages before it, and its text."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(earlier)
    rows = turns.withColumn("prompt", prefix).filter("role = 'assistant'")
    return rows.select("conv_id", "turn", "prompt", F.col("text").alias("completion"))


def assistant_spans(turns: DataFrame) -> DataFrame:
    """Character offsets [start, end) of the assistant's turns in each conversation."""
    n = F.length("text")
    upto = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("end", F.sum(n).over(upto)).withColumn("start", F.col("end") - n)
    return rows.filter("role = 'assistant'").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def mask_lengths(turns: DataFrame, most: int) -> DataFrame:
    """Per conversation: characters kept under the limit, and those of the assistant among them."""
    upto = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    rows = turns.withColumn("end", F.sum(n).over(upto)).withColumn("start", F.col("end") - n)
    kept = F.greatest(F.least("end", F.lit(most)) - F.col("start"), F.lit(0))
    return rows.groupBy("conv_id").agg(
        F.sum(kept).cast("long").alias("kept"),
        F.sum(F.when(F.col("role") == "assistant", kept).otherwise(0)).cast("long").alias("trained"),
        (F.max("end") > most).alias("truncated"),
    )


def turns_per_episode(turns: DataFrame) -> DataFrame:
    by_role = lambda r: F.count(F.when(F.col("role") == r, 1))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), by_role("assistant").alias("n_assistant"), by_role("user").alias("n_user"))


def replay(episodes: DataFrame, actions: str = "actions", max_turns: int = MAX_TURNS, results: str | None = None) -> DataFrame:
    """``episodes`` with how each ends, from its ordered array of assistant texts.

    A statement is submitted and ends the episode. A tool call, or a text that is
    neither (malformed), is answered and goes on; at turn ``max_turns`` either ends it.
    Adds: reason, turns, tool_calls, final_sql; with ``results``, a column that maps the
    text of a tool call to what the tool said, also ``steps``: the assistant's texts and
    the answers to them as (role, content).
    """
    none = F.array().cast("array<struct<role:string,content:string>>")
    start = F.struct(F.lit("running").alias("reason"), F.lit(0).alias("turns"), F.lit(0).alias("tool_calls"), F.lit("").alias("final_text"), none.alias("steps"))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))

    def step(s: Column, text: Column) -> Column:
        tool = tx.tool_call(text).isNotNull()
        answer = ~tool & tx.looks_like_select(tx.extract_statement(text))
        last = s["turns"] + 1 >= max_turns
        reason = F.when(answer, "submitted").when(last & tool, "max_turns").when(last, "malformed_final").otherwise("running")
        steps = s["steps"]
        if results:
            call = F.regexp_extract(F.coalesce(text, F.lit("")), tx.TOOL_CALL, 1)
            reply = F.when(tool, F.coalesce(F.col(results)[call], F.lit(UNKNOWN_CALL))).when(~answer & ~last, CORRECTION)
            steps = F.concat(steps, F.array(said("assistant", text)), F.when(reply.isNotNull(), F.array(said("tool", reply))).otherwise(none))
        after = F.struct(
            reason.alias("reason"),
            (s["turns"] + 1).alias("turns"),
            (s["tool_calls"] + tool.cast("int")).alias("tool_calls"),
            F.when(answer, text).otherwise(s["final_text"]).alias("final_text"),
            steps.alias("steps"),
        )
        return F.when(s["reason"] == "running", after).otherwise(s)

    end = F.aggregate(F.col(actions), start, step)
    out = episodes.withColumn("__end", end)
    return out.withColumns(
        {
            "reason": F.when(F.col("__end.reason") == "running", "unfinished").otherwise(F.col("__end.reason")),
            "turns": F.col("__end.turns"),
            "tool_calls": F.col("__end.tool_calls"),
            "final_sql": tx.extract_statement(F.col("__end.final_text")),
            **({"steps": F.col("__end.steps")} if results else {}),
        }
    ).drop("__end")


def tool_results(episodes: DataFrame, tools: Tools, actions: str = "actions") -> DataFrame:
    """``episodes`` with ``results``: what the tools say to each of the episode's calls, by the call's text."""
    keyed = episodes.withColumn("__row", F.monotonically_increasing_id())
    text = keyed.select("__row", F.explode(actions).alias("text"))
    asked = text.select("__row", F.regexp_extract(F.coalesce("text", F.lit("")), tx.TOOL_CALL, 1).alias("raw"), tx.tool_call(F.col("text")).alias("call")).filter("raw <> ''")
    answers = tools.answered(asked.select("raw", "call"))
    pairs = asked.select("__row", "raw").distinct().join(answers, "raw")
    found = pairs.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "said"))).alias("results"))
    none = F.create_map().cast("map<string,string>")
    return keyed.join(found, "__row", "left").drop("__row").withColumn("results", F.coalesce("results", none))


class Tools:
    """The tools of a query environment over the session's catalog.

    Whatever a call asks for, its answer is a text: failures and time limits are told in it.
    """

    def __init__(self, spark, row_limit: int = ROWS_SHOWN, seconds: float = exec_match.LIMIT_SECONDS):
        self.spark, self.row_limit, self.seconds = spark, row_limit, seconds

    def call(self, name: str, args: dict[str, str] | None = None) -> str:
        said, error = exec_match.attempt(self.spark, lambda: self._answer(name, args or {}), self.seconds)
        return said if error is None else f"error: {error}"

    def answered(self, calls: DataFrame) -> DataFrame:
        """(raw, said): the answer to each distinct call of ``calls`` (raw, call), side by side in slices."""
        distinct = calls.groupBy("raw").agg(F.first("call").alias("call"))
        found = exec_match.answered(distinct, lambda r: (self._answer(r.call.name, r.call.args or {}),), "said string", self.seconds)
        return found.select("raw", F.coalesce("said", F.concat(F.lit("error: "), "failure")).alias("said"))

    def _answer(self, name: str, args: dict[str, str]) -> str:
        if name == "list_tables":
            return "\n".join(self._tables())
        if name in ("describe_table", "sample_rows"):
            table = args.get("table") or ""
            if table not in self._tables():
                return f"no table {table!r}"
            df = self.spark.table(f"`{table.replace('`', '``')}`")
            if name == "describe_table":
                return "\n".join(f"{c} {kind}" for c, kind in df.dtypes)
            plain = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
            return self._shown(df.orderBy(*plain).limit(3))
        if name == "run_query":
            df, error = exec_match.run_sql(self.spark, args.get("sql") or "")
            if error and error.startswith("refused"):
                return REFUSAL
            return f"error: {error}" if df is None else self._shown(df)
        return "bad JSON in the tool call" if name == "__bad_json__" else f"no tool {name!r}"

    def _tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def _shown(self, df: DataFrame) -> str:
        rows = df.limit(self.row_limit + 1).collect()
        n = df.count() if len(rows) > self.row_limit else len(rows)
        more = f" (+{n - self.row_limit} more rows)" if n > self.row_limit else ""
        return f"{n} row(s): {[tuple(r) for r in rows[: self.row_limit]]}{more}"


# ---- Training histories: (run, step, metric) ---------------------------------


def step_history(df: DataFrame, run: str, step: str, group: str, reward: str, turns: str, loss: str) -> DataFrame:
    """Per run and step over (group, reward, turns, loss): mean reward, mean turns, mean loss and
    the share of groups whose rewards, to six places, are all the same."""
    groups = df.groupBy(run, step, group).agg(
        F.sum(reward).alias("__r"), F.sum(turns).alias("__t"), F.sum(loss).alias("__l"), F.count(F.lit(1)).alias("__n"),
        (F.countDistinct(F.round(reward, 6)) <= 1).cast("int").alias("__flat"),
    )
    mean = lambda c: F.sum(c) / F.sum("__n")
    return groups.groupBy(run, step).agg(mean("__r").alias("reward"), mean("__t").alias("mean_turns"), mean("__l").alias("loss"), F.avg("__flat").alias("zero_advantage"))


def filled_history(df: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """``df`` with ``filled``: the last measured value, and before the first one, that one."""
    back = Window.partitionBy(run).orderBy(step)
    ahead = back.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("filled", F.coalesce(F.last(metric, True).over(back), F.first(metric, True).over(ahead)))


def chart_series(df: DataFrame, run: str, step: str, panels: dict[str, tuple[str, ...]]) -> DataFrame:
    """(run, panel, metric, step, value): what each panel draws of each run.

    A panel has the columns it accepts, in order, and takes the first that the run has
    any value of; steps without a value leave no point.
    """
    options = [F.struct(F.lit(p).alias("panel"), F.lit(i).alias("__i"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for p, cs in panels.items() for i, c in enumerate(cs)]
    points = df.select(run, step, F.inline(F.array(*options))).filter("value IS NOT NULL")
    first = points.groupBy(run, "panel").agg(F.min("__i").alias("__i"))
    return points.join(first, [run, "panel", "__i"]).select(run, "panel", "metric", step, "value")


def validation_gate(df: DataFrame, run: str, step: str, metric: str, patience: int = 3) -> DataFrame:
    """Per run, over measured steps only: best value, the step to promote, where patience ends, and why."""
    rows = df.filter(F.col(metric).isNotNull()).select(run, F.col(step).alias("__s"), F.col(metric).alias("__m"))
    upto = Window.partitionBy(run).orderBy("__s")
    rows = rows.withColumn("__best", F.max("__m").over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__up", F.col("__best").isNull() | (F.col("__m") > F.col("__best")))
    rows = rows.withColumn("__run_of", F.sum(F.col("__up").cast("int")).over(upto))
    since = F.row_number().over(Window.partitionBy(run, "__run_of").orderBy("__s")) - 1
    rows = rows.withColumn("__since", since)
    stop = F.min(F.when(F.col("__since") >= patience, F.col("__s")))
    stops = rows.groupBy(run).agg(stop.alias("stop_step"))
    seen = rows.join(stops, run).filter(F.col("stop_step").isNull() | (F.col("__s") <= F.col("stop_step")))
    best = F.max(F.struct(F.col("__m").alias("m"), (-F.col("__s")).alias("s")))
    return seen.groupBy(run, "stop_step").agg(best.alias("__top")).select(
        run,
        F.col("__top.m").alias("best"),
        (-F.col("__top.s")).alias("promote_step"),
        "stop_step",
        F.when(F.col("stop_step").isNull(), "ran_to_end").otherwise("patience").alias("reason"),
    )


def pathologies(df: DataFrame, run: str, step: str) -> DataFrame:
    """Per run over (kl, reward, reward_std, length): signs of a training gone wrong."""
    first_last = lambda c: (F.min_by(c, step), F.max_by(c, step))
    kl0, kl1 = first_last("kl")
    _, reward1 = first_last("reward")
    _, length1 = first_last("length")
    return df.groupBy(run).agg(
        (kl1 > 10 * kl0).alias("kl_exploded"),
        (F.avg((F.col("reward_std") < EPSILON).cast("int")) > 0.7).alias("groups_collapsed"),
        (length1 <= 26).alias("too_short"),
        (reward1 < 0.5 * F.max("reward")).alias("reward_fell"),
    )


def external_metrics(df: DataFrame, parts: str, *counters: str) -> DataFrame:
    """``df`` with ``metrics``: the map of reward parts and the named counters in one map."""
    own = F.create_map(*(x for c in counters for x in (F.lit(c), F.col(c).cast("double"))))
    return df.withColumn("metrics", F.map_concat(F.col(parts), own))
