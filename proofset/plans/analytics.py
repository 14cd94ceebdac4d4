"""Queries over groups, conversations, histories, statistics and accounting."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.functions import stats
from proofset.functions import text as tx
from proofset.operators import datasets, evaluation, rewards, trajectories, taskgen
from proofset.plans.relational import SHOP
from proofset.plans.textual import COMPOSITE_SQL, FACTS, NORM, facts
from proofset.sources import tables as t
from proofset.sources.records import cut, scratch_path
from proofset.streaming import episodes
from proofset.streaming import events as ev


def _r(name: str, places: int = 6):
    return F.round(name, places).alias(name)


def events(s: SparkSession, d: str) -> DataFrame:
    """Members of groups: user is the group, value the reward, a purchase is a success."""
    return t.load(s, d, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_type") == "purchase").alias("correct"))


MOMENTS = "m AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY user_id)"


def advantage(s, d):
    return trajectories.advantages(events(s, d), "user_id", "value").select("event_id", _r("advantage", 5))


def advantage_unscaled(s, d):
    return trajectories.advantages(events(s, d), "user_id", "value", scale=False).select("event_id", _r("advantage", 5))


def group_summary(s, d):
    out = trajectories.group_summary(events(s, d), "user_id", "value", "correct", "event_id")
    return out.select("user_id", "g", _r("reward_mean"), _r("reward_std"), "reward_min", "reward_max", _r("pass_rate"), "pass_at_1", "pass_at_g", F.col("zero_advantage").cast("int").alias("zero_advantage"))


GROUP_SQL = """SELECT user_id, count(*) AS g, round(avg(value), 6) AS reward_mean, round(stddev_pop(value), 6) AS reward_std, min(value) AS reward_min, max(value) AS reward_max,
 round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS pass_rate, arg_min(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id) AS pass_at_1,
 max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS pass_at_g, CAST(stddev_pop(value) < 1e-4 AS INTEGER) AS zero_advantage FROM events GROUP BY user_id"""


def learnable_band(s, d):
    return trajectories.learnable_band(events(s, d), "user_id", "correct", 0.125, 0.22).select("user_id", _r("pass_rate"))


def probe_band(s, d):
    return trajectories.probe_band(events(s, d), "user_id", "correct", 100, 0.125, 0.22).select("user_id", _r("probe_rate"))


def pass_at_k(s, d):
    return trajectories.pass_at_k(events(s, d), "user_id", "correct", "event_id", 4).select(_r("pass_at_k"))


def zero_advantage_fraction(s, d):
    rounded = t.load(s, d, "conversations").select("conv_id", F.floor(F.length("text") / 4000).cast("double").alias("reward"))
    return trajectories.zero_advantage_fraction(rounded, "conv_id", "reward").select(_r("zero_advantage_fraction"))


def conversations(s, d):
    return t.load(s, d, "conversations")


def episode_pairs(s, d):
    pairs = trajectories.episode_pairs(conversations(s, d))
    text = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return pairs.select("conv_id", "turn", F.size("prompt").cast("long").alias("n_prompt"), F.md5(text).alias("prompt"), F.md5("completion").alias("completion"))


EPISODE_SQL = """WITH w AS (SELECT conv_id, turn, role, text, string_agg(concat(role, ':', text), '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM conversations)
SELECT conv_id, turn, n AS n_prompt, md5(coalesce(before, '')) AS prompt, md5(text) AS completion FROM w WHERE role = 'assistant'"""
OFFSETS = "o AS (SELECT conv_id, turn, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS start FROM conversations)"


def mask_lengths(s, d):
    return trajectories.mask_lengths(conversations(s, d), 3000).withColumn("truncated", F.col("truncated").cast("int"))


MASK_SQL = f"""WITH {OFFSETS}, k AS (SELECT conv_id, role, stop, greatest(least(stop, 3000) - start, 0) AS kept FROM o)
SELECT conv_id, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(CASE WHEN role = 'assistant' THEN kept ELSE 0 END) AS BIGINT) AS trained, CAST(max(stop) > 3000 AS INTEGER) AS truncated FROM k GROUP BY conv_id"""


def replay(s, d):
    """Episodes made of conversations: the assistant's texts, some turned into calls and statements."""
    text = """CASE WHEN (conv_id + turn) % 5 = 1 THEN concat('<tool>{"name": "list_tables", "args": {}}</tool>', substring(text, 1, 5))
              WHEN (conv_id + turn) % 5 = 3 THEN '```sql SELECT 1 ```' ELSE 'no idea' END"""
    turns = conversations(s, d).filter("role = 'assistant'").select("conv_id", "turn", F.expr(text).alias("text"))
    episodes = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("actions"))
    return trajectories.replay(episodes, "actions", 4).select("conv_id", "reason", "turns", "tool_calls", "final_sql")


#: An episode ends at its first statement or its fourth turn.
REPLAY_SQL = """WITH a AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    CASE WHEN (conv_id + turn) % 5 = 1 AND text IS NOT NULL THEN 'call' WHEN (conv_id + turn) % 5 = 3 THEN 'answer' ELSE 'bad' END AS kind
  FROM conversations WHERE role = 'assistant'
), e AS (SELECT conv_id, min(i) FILTER (kind = 'answer') AS answer, max(i) AS n FROM a GROUP BY conv_id),
f AS (SELECT *, least(answer, 4, n) AS turns FROM e)
SELECT f.conv_id, CASE WHEN turns = answer THEN 'submitted' WHEN turns < 4 THEN 'unfinished' WHEN count(*) FILTER (i = 4 AND kind = 'call') > 0 THEN 'max_turns' ELSE 'malformed_final' END AS reason,
  CAST(turns AS INTEGER) AS turns, CAST(count(*) FILTER (kind = 'call' AND i <= turns) AS INTEGER) AS tool_calls,
  CASE WHEN turns = answer THEN 'SELECT 1' ELSE '' END AS final_sql
FROM f JOIN a ON a.conv_id = f.conv_id GROUP BY f.conv_id, turns, answer"""


def episode_stream(s, d):
    """As ``replay``, by the stateful stream: half of the texts come first, and so ahead of their turn."""
    text = """CASE WHEN (conv_id + turn) % 5 = 1 THEN concat('<tool>{"name": "list_tables", "args": {}}</tool>', text)
              WHEN (conv_id + turn) % 5 = 3 THEN '```sql SELECT 1 ```' ELSE concat('no idea of ', replace(text, '<tool>', '')) END"""
    step = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    said = conversations(s, d).filter("role = 'assistant'").select(F.col("conv_id").alias("episode"), step.alias("step"), F.expr(text).alias("text"))
    folder = scratch_path(s, "episodes")
    for part in (1, 0):
        said.filter(F.pmod(F.xxhash64("episode", "step"), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
    texts = s.readStream.schema(said.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    episodes.start(texts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return episodes.outcomes(s, f"{folder}/out", f"{folder}/checkpoint").withColumnRenamed("episode", "conv_id")


def rollout_steps(s, d):
    """Episodes of whole conversations: by length a text is a call of one of two tools, a statement, or as it is."""
    for name in ("region", "nation"):
        t.load(s, d, name).createOrReplaceTempView(f"rollout_{name}")
    text = """CASE length(text) % 5 WHEN 1 THEN '<tool>{"name": "run_query", "args": {"sql": "SELECT count(*) FROM rollout_nation"}}</tool>'
              WHEN 2 THEN '<tool>{"name": "run_query", "args": {"sql": "SELECT r_regionkey, r_name FROM rollout_region ORDER BY r_regionkey"}}</tool>'
              WHEN 3 THEN concat('```sql SELECT ', turn, ' ```') ELSE concat('I say: ', replace(text, '<tool>', '')) END"""
    turns = conversations(s, d).filter("role = 'assistant'").select("conv_id", "turn", F.expr(text).alias("text"))
    episodes = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("actions"))
    told = trajectories.tool_results(episodes, trajectories.Tools(s, 2))
    out = trajectories.replay(told, "actions", 3, "results")
    steps = F.array_join(F.transform("steps", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("conv_id", "reason", "turns", "tool_calls", "final_sql", F.md5(steps).alias("steps"))


ROLLOUT_SQL = f"""WITH w AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) % 5 AS kind, CASE length(text) % 5
    WHEN 1 THEN '<tool>{{"name": "run_query", "args": {{"sql": "SELECT count(*) FROM rollout_nation"}}}}</tool>'
    WHEN 2 THEN '<tool>{{"name": "run_query", "args": {{"sql": "SELECT r_regionkey, r_name FROM rollout_region ORDER BY r_regionkey"}}}}</tool>'
    WHEN 3 THEN concat('```sql SELECT ', turn, ' ```') ELSE concat('I say: ', replace(text, '<tool>', '')) END AS said, turn
  FROM conversations WHERE role = 'assistant'
), n AS (SELECT count(*) AS n FROM nation), g AS (
  SELECT count(*) AS n, string_agg(concat('(', r_regionkey, ', ', chr(39), r_name, chr(39), ')'), ', ' ORDER BY r_regionkey) FILTER (p <= 2) AS shown FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS p FROM region)
), a AS (
  SELECT w.*, CASE kind WHEN 1 THEN concat('1 row(s): [(', n.n, ',)]') WHEN 2 THEN concat(g.n, ' row(s): [', g.shown, ']', CASE WHEN g.n > 2 THEN concat(' (+', g.n - 2, ' more rows)') ELSE '' END)
    WHEN 3 THEN NULL ELSE CASE WHEN i < 3 THEN '{trajectories.CORRECTION}' END END AS reply FROM w, n, g
), e AS (SELECT conv_id, min(i) FILTER (kind = 3) AS answer, max(i) AS n FROM a GROUP BY conv_id), f AS (SELECT *, least(answer, 3, n) AS turns FROM e)
SELECT f.conv_id, CASE WHEN turns = answer THEN 'submitted' WHEN turns < 3 THEN 'unfinished' WHEN count(*) FILTER (i = 3 AND kind IN (1, 2)) > 0 THEN 'max_turns' ELSE 'malformed_final' END AS reason,
  CAST(turns AS INTEGER) AS turns, CAST(count(*) FILTER (kind IN (1, 2) AND i <= turns) AS INTEGER) AS tool_calls,
  coalesce(max(CASE WHEN i = answer AND i <= turns THEN concat('SELECT ', turn) END), '') AS final_sql,
  md5(string_agg(CASE WHEN i <= turns THEN concat('assistant:', said, CASE WHEN reply IS NULL THEN '' ELSE concat('|tool:', reply) END) END, '|' ORDER BY i)) AS steps
FROM f JOIN a ON a.conv_id = f.conv_id GROUP BY f.conv_id, turns, answer"""


def reward_bounds(s, d):
    """How correct and incorrect completions score, beside the bound that the weights give each."""
    bounds = rewards.Weights().bounds()
    scored = rewards.composite(facts(s, d)).select("correct", "reward")
    spread = scored.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.min("reward").alias("least"), F.max("reward").alias("most"))
    bound = F.when(F.col("correct"), F.lit(bounds["min_correct"])).otherwise(F.lit(bounds["max_incorrect"])).alias("bound")
    return spread.select(F.col("correct").cast("int").alias("correct"), "n", _r("least"), _r("most"), F.round(bound, 6).alias("bound"))


BOUNDS_SQL = f"""WITH r AS ({COMPOSITE_SQL}), f AS (SELECT doc_id, {FACTS} FROM documents)
SELECT CAST(correct AS INTEGER) AS correct, count(*) AS n, round(min(reward), 6) AS least, round(max(reward), 6) AS most,
 CASE WHEN correct THEN round(1.0e0 + 0.1e0 + 0.05e0 - 3 * 0.05e0, 6) ELSE round(0.15e0 + 0.1e0 + 0.05e0, 6) END AS bound FROM r JOIN f ON f.doc_id = r.doc_id GROUP BY correct"""


def training_history(s, d):
    """Steps are days, groups users; turns and losses come from ids and values."""
    rows = t.load(s, d, "events").select(F.lit(0).alias("run"), F.dayofmonth("ts").alias("step"), "user_id", F.floor("value").alias("reward"), (F.col("event_id") % 4 + 1).alias("turns"), (F.col("event_id") % 7).alias("loss"))
    return trajectories.step_history(rows, "run", "step", "user_id", "reward", "turns", "loss").select("step", _r("reward"), _r("mean_turns"), _r("loss"), _r("zero_advantage"))


HISTORY_SQL = """WITH g AS (SELECT day(ts) AS step, user_id, sum(floor(value)) AS r, sum(event_id % 4 + 1) AS t, sum(event_id % 7) AS l, count(*) AS n, CAST(count(DISTINCT floor(value)) <= 1 AS INTEGER) AS flat FROM events GROUP BY 1, 2)
SELECT step, round(sum(r) * 1.0e0 / sum(n), 6) AS reward, round(sum(t) * 1.0e0 / sum(n), 6) AS mean_turns, round(sum(l) * 1.0e0 / sum(n), 6) AS loss, round(avg(flat), 6) AS zero_advantage FROM g GROUP BY step"""


def sft_rows(s, d):
    """The kept sample of each source as a training row."""
    rows = datasets.rejection_sample(samples(s, d), "source", "correct", "text", "doc_id").select(F.concat(F.lit("Say "), "source").alias("question"), "sql", "source")
    out = datasets.sft_rows(rows, "t(a)")
    flat = lambda c: F.md5(F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))
    return out.select("source", flat("prompt").alias("prompt"), flat("completion").alias("completion"))


def _sft_sql() -> str:
    return f"""WITH {SAMPLES}, r AS ({_best('correct')})
SELECT source, md5(concat('system:{tx.SYSTEM}|user:Tables:', chr(10), 't(a)', chr(10), chr(10), 'Question: Say ', source)) AS prompt,
 md5(concat('assistant:```sql', chr(10), sql, chr(10), '```')) AS completion FROM r"""


def history(s, d):
    """Runs are users, steps their events, the metric is measured at purchases and clicks only."""
    return t.load(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("purchase", "click"), F.col("value")).alias("metric"))


HISTORY = "h AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'click') THEN value END AS metric FROM events)"


def filled_history(s, d):
    return trajectories.filled_history(history(s, d), "user_id", "event_id", "metric").select("event_id", "filled")


FILLED_SQL = f"""WITH {HISTORY} SELECT event_id, coalesce(last_value(metric IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(metric IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM h"""


PANELS = {"reward": ("proxy", "reward"), "truth": ("accuracy",)}


def chart_series(s, d):
    """Users are runs: the proxy is known at purchases, the reward at every even event, the accuracy at clicks."""
    rows = t.load(s, d, "events").selectExpr("user_id", "event_id", "CASE WHEN event_type = 'purchase' THEN value END AS proxy", "CASE WHEN event_id % 2 = 0 THEN value + 1 END AS reward", "CASE WHEN event_type = 'click' THEN value END AS accuracy")
    return trajectories.chart_series(rows, "user_id", "event_id", PANELS)


CHART_SQL = """WITH e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS bought FROM events)
SELECT user_id, 'reward' AS panel, 'proxy' AS metric, event_id, value FROM e WHERE event_type = 'purchase' AND value IS NOT NULL
UNION ALL SELECT user_id, 'reward', 'reward', event_id, value + 1 FROM e WHERE bought = 0 AND event_id % 2 = 0 AND value IS NOT NULL
UNION ALL SELECT user_id, 'truth', 'accuracy', event_id, value FROM e WHERE event_type = 'click' AND value IS NOT NULL"""


def validation_gate(s, d):
    return trajectories.validation_gate(history(s, d), "user_id", "event_id", "metric", 5)


GATE_SQL = f"""WITH {HISTORY}, a AS (SELECT user_id, event_id AS s, metric AS m, max(metric) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM h WHERE metric IS NOT NULL),
c AS (SELECT *, sum(CASE WHEN b IS NULL OR m > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS g FROM a),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY s) - 1 AS since FROM c),
f AS (SELECT user_id, min(CASE WHEN since >= 5 THEN s END) AS stop_step FROM e GROUP BY user_id),
k AS (SELECT e.user_id, f.stop_step, e.m, e.s FROM e JOIN f ON f.user_id = e.user_id WHERE f.stop_step IS NULL OR e.s <= f.stop_step),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, s) AS place FROM k)
SELECT user_id, m AS best, s AS promote_step, stop_step, CASE WHEN stop_step IS NULL THEN 'ran_to_end' ELSE 'patience' END AS reason FROM r WHERE place = 1"""


def pathologies(s, d):
    rows = t.load(s, d, "events").select("user_id", "event_id", (F.col("value") + 0.5).alias("kl"), F.col("value").alias("reward"), (F.col("event_id") % 3).cast("double").alias("reward_std"), (F.col("event_id") % 60).alias("length"))
    out = trajectories.pathologies(rows, "user_id", "event_id")
    return out.select("user_id", *(F.col(c).cast("int").alias(c) for c in out.columns[1:]))


PATHOLOGY_SQL = """SELECT user_id, CAST(arg_max(value, event_id) + 0.5e0 > 10 * (arg_min(value, event_id) + 0.5e0) AS INTEGER) AS kl_exploded,
 CAST(avg(CASE WHEN event_id % 3 < 1e-4 THEN 1 ELSE 0 END) > 0.7 AS INTEGER) AS groups_collapsed, CAST(arg_max(event_id % 60, event_id) <= 26 AS INTEGER) AS too_short,
 CAST(arg_max(value, event_id) < 0.5e0 * max(value) AS INTEGER) AS reward_fell FROM events GROUP BY user_id"""


# ---- Samples: the source is the task, quality 1 is correct ----------------------
def samples(s, d):
    docs = t.load(s, d, "documents").select("doc_id", "source", "lang", "text")
    return docs.join(t.load(s, d, "labels"), "doc_id").withColumn("correct", F.col("quality") == 1)


SAMPLES = "x AS (SELECT d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic, l.quality = 1 AS correct FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def star_sample(s, d):
    return datasets.rejection_sample(samples(s, d), "source", "correct", "text", "doc_id").select("source", F.md5("sql").alias("sql"), "n_correct_of_k", "k")


STAR_SQL = f"""WITH {SAMPLES}, r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS p FROM x WHERE correct),
c AS (SELECT source, count(*) FILTER (WHERE correct) AS n_correct_of_k, count(*) AS k FROM x GROUP BY source)
SELECT r.source, md5(r.text) AS sql, n_correct_of_k, k FROM r JOIN c ON c.source = r.source WHERE p = 1"""


def star_first(s, d):
    return datasets.first_candidate(samples(s, d), "source", "text", "doc_id").select("source", F.md5("sql").alias("sql"))


def star_yield(s, d):
    return datasets.yield_by_level(samples(s, d), "source", "lang", "correct")


def ablation_arms(s, d):
    rows = samples(s, d)
    kept = datasets.rejection_sample(rows, "source", "correct", "text", "doc_id")
    clean = datasets.rejection_sample(rows.filter("toxic = 0"), "source", "correct", "text", "doc_id")
    out = datasets.arms(kept, datasets.first_candidate(rows, "source", "text", "doc_id"), clean, "source")
    return out.select("arm", "source", F.md5("sql").alias("sql"))


def _best(condition: str) -> str:
    return f"SELECT source, text AS sql FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS p FROM x WHERE {condition}) WHERE p = 1"


ARMS_SQL = f"""WITH {SAMPLES}, a AS ({_best('correct')}), b AS (SELECT source, arg_min(text, doc_id) AS sql FROM x GROUP BY source), c AS ({_best('correct AND toxic = 0')}),
n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b), (SELECT count(*) FROM c)) AS n),
u AS (SELECT 'filtered' AS arm, * FROM a UNION ALL SELECT 'unfiltered', * FROM b UNION ALL SELECT 'no_leak', * FROM c),
r AS (SELECT arm, source, sql, row_number() OVER (PARTITION BY arm ORDER BY md5(concat('1234:', source)), source) AS p FROM u)
SELECT arm, source, md5(sql) AS sql FROM r WHERE p <= (SELECT n FROM n)"""


def eval_by_level(s, d):
    return evaluation.by_level(samples(s, d), "lang").select("lang", "correct", "n", _r("accuracy"))


def wilson(s, d):
    out = evaluation.with_interval(evaluation.by_level(samples(s, d), "lang"))
    return out.select("lang", _r("low"), _r("high"))


Z = 1.9599640
WILSON = f"""(k / n + {Z * Z!r}e0 / (2.0e0 * n)) / (1.0e0 + {Z * Z!r}e0 / n)"""
HALF = f"""{Z!r}e0 * sqrt(k / n * (1.0e0 - k / n) / n + {Z * Z!r}e0 / (4.0e0 * n * n)) / (1.0e0 + {Z * Z!r}e0 / n)"""
LEVELS = f"{SAMPLES}, g AS (SELECT lang, CAST(sum(CAST(correct AS INTEGER)) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ROLLUP (lang))"


def report_number(s, d):
    out = evaluation.by_level(samples(s, d), "lang")
    return out.select("lang", stats.report(F.col("correct"), F.col("n")).alias("report"))


REPORT_SQL = f"WITH {LEVELS} SELECT lang, printf('%.3f  [%.3f, %.3f]  (%d/%d)', k / n, greatest(0.0e0, {WILSON} - {HALF}), least(1.0e0, {WILSON} + {HALF}), CAST(k AS BIGINT), CAST(n AS BIGINT)) AS report FROM g"


def mcnemar_counts(s, d):
    return stats.discordant(samples(s, d).withColumn("b", 1 - F.col("toxic")), "quality", "b").withColumn("delta", F.round("delta", 6))


MCNEMAR_SQL = f"""WITH {SAMPLES} SELECT count(*) FILTER (WHERE quality > 1 - toxic) AS a_only, count(*) FILTER (WHERE 1 - toxic > quality) AS b_only, count(*) FILTER (WHERE quality <> 1 - toxic) AS n_discordant,
count(*) FILTER (WHERE quality = 1 - toxic) AS ties, count(*) AS n, round(sum(1 - toxic - quality) * 1.0e0 / count(*), 6) AS delta FROM x"""


def mcnemar_test(s, d):
    """Both forms of the paired test over all labelled items."""
    pairs = samples(s, d).withColumn("b", 1 - F.col("toxic"))
    found = [stats.mcnemar(pairs, "quality", "b", exact)["p_two_sided"] for exact in (True, False)]
    return s.createDataFrame([tuple(found)], "p_exact double, p_approximate double").select(_r("p_exact"), _r("p_approximate"))


MCNEMAR_P_SQL = f"""WITH {SAMPLES}, c AS (SELECT count(*) FILTER (quality > 1 - toxic) AS a, count(*) FILTER (1 - toxic > quality) AS b FROM x), e AS (SELECT *, a + b AS n FROM c),
i AS (SELECT *, unnest(range(0, least(a, b) + 1)) AS i FROM e), t AS (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0e0))) AS tail FROM i)
SELECT round(least(1.0e0, 2 * tail), 6) AS p_exact, CASE WHEN n = 0 THEN 1.0e0 ELSE round(exp(-pow(abs(b - a) - 1, 2) / n / 2.0e0), 6) END AS p_approximate FROM t, e"""


def external_metrics(s, d):
    """Events as trajectories: the value is the only reward part, two counters come from ids."""
    rows = t.load(s, d, "events").select("event_id", F.create_map(F.lit("value"), F.col("value")).alias("parts"), (F.col("event_id") % 4).alias("turns"), (F.col("event_id") % 3).alias("calls"))
    return trajectories.external_metrics(rows, "parts", "turns", "calls").select("event_id", *(F.col("metrics")[n].alias(f"m_{n}") for n in ("value", "turns", "calls")))


def bootstrap_means(s, d):
    diffs = samples(s, d).select((1 - F.col("toxic") - F.col("quality")).alias("d"))
    return stats.bootstrap_means(diffs, "d", 20).withColumn("mean", F.round("mean", 6))


BOOT_SQL = f"""WITH {SAMPLES}, v AS (SELECT 1 - toxic - quality AS d FROM x), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE d = -1) AS lo, count(*) FILTER (WHERE d <= 0) AS mid FROM v),
r AS (SELECT unnest(range(0, 20)) AS resample), q AS (SELECT unnest(range(0, (SELECT n FROM n))) AS draw),
h AS (SELECT resample, CAST(('0x' || substring(md5(concat('boot0:', CAST(resample AS VARCHAR), ':', CAST(draw AS VARCHAR))), 1, 12)) AS BIGINT) % n AS place, lo, mid, n FROM r, q, n)
SELECT resample, round(sum(CASE WHEN place < lo THEN -1.0e0 WHEN place < mid THEN 0.0e0 ELSE 1.0e0 END) / max(n), 6) AS mean FROM h GROUP BY resample"""


def paired_interval(s, d):
    """The paired bootstrap with its own number of resamples, drawn item by item as its SQL does."""
    return _interval(s, d, by_items=True)


def paired_interval_counts(s, d):
    """The paired bootstrap drawn as counts: its work does not grow with resamples times items."""
    return _interval(s, d, by_items=False)


def _interval(s, d, by_items):
    found = stats.paired_bootstrap(samples(s, d).withColumn("b", 1 - F.col("toxic")), "quality", "b", by_items=by_items)
    row = (found["delta"], *found["ci"], found["p_two_sided"], found["n"])
    return s.createDataFrame([row], "delta double, low double, high double, p double, n long").select(_r("delta"), _r("low"), _r("high"), _r("p"), "n")


INTERVAL_SQL = f"""WITH {SAMPLES}, v AS (SELECT 1 - toxic - quality AS d FROM x), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE d = -1) AS lo, count(*) FILTER (WHERE d <= 0) AS mid, sum(d) * 1.0e0 / count(*) AS delta FROM v),
r AS (SELECT unnest(range(0, 10000)) AS resample), q AS (SELECT unnest(range(0, (SELECT n FROM n))) AS draw),
h AS (SELECT resample, CAST(('0x' || substring(md5(concat('boot0:', CAST(resample AS VARCHAR), ':', CAST(draw AS VARCHAR))), 1, 12)) AS BIGINT) % n AS place, lo, mid, n FROM r, q, n),
m AS (SELECT resample, sum(CASE WHEN place < lo THEN -1.0e0 WHEN place < mid THEN 0.0e0 ELSE 1.0e0 END) / max(n) AS mean FROM h GROUP BY resample),
o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS spot FROM m)
SELECT round(max(delta), 6) AS delta, round(max(mean) FILTER (WHERE spot = 250), 6) AS low, round(max(mean) FILTER (WHERE spot = 9750), 6) AS high, round(count(*) FILTER (WHERE abs(mean - delta) >= abs(delta)) / 10000.0e0, 6) AS p, max(n) AS n FROM o, n"""


def seed_summary(s, d):
    runs = events(s, d).groupBy((F.col("user_id") % 7).alias("config"), "user_id").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    out = stats.seed_summary(runs, "accuracy", "config")
    return out.select("config", _r("mean"), _r("std"), _r("min"), _r("max"), "n")


SEED_SQL = """WITH r AS (SELECT user_id % 7 AS config, user_id, avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS accuracy FROM events GROUP BY 1, 2)
SELECT config, round(avg(accuracy), 6) AS mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS std, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max, count(*) AS n FROM r GROUP BY config"""


def p50_p95(s, d):
    return stats.nearest_rank(events(s, d), "value", "event_type", {"p50": 0.5, "p95": 0.95})


P_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(CASE WHEN p = n // 2 THEN value END) AS p50, min(CASE WHEN p = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1) THEN value END) AS p95 FROM r GROUP BY event_type"""

PRED = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '-- agent error: Timeout' WHEN 2 THEN 'I cannot' ELSE 'SELECT 1' END AS pred"
FAILURE = """CASE WHEN doc_id % 6 = 3 THEN 'UNRESOLVED_COLUMN.WITH_SUGGESTION: x' WHEN doc_id % 12 = 4 THEN 'TABLE_OR_VIEW_NOT_FOUND: t'
 WHEN doc_id % 24 = 5 THEN 'DIVIDE_BY_ZERO: z' END AS error"""
CORRECT = "doc_id % 7 = 0 AS correct"


def error_taxonomy(s, d):
    return evaluation.error_taxonomy(t.load(s, d, "documents").selectExpr("doc_id", PRED, FAILURE, CORRECT))


TAXONOMY_SQL = f"""WITH r AS (SELECT doc_id, {PRED}, {FAILURE}, {CORRECT} FROM documents)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN correct THEN NULL WHEN pred = '' THEN 'empty_output' WHEN pred LIKE '-- agent error%' THEN 'agent_crashed' WHEN pred NOT LIKE 'SELECT%' THEN 'not_a_select'
 WHEN error IS NULL THEN 'ran_but_wrong' WHEN error LIKE 'UNRESOLVED_COLUMN%' THEN 'hallucinated_column' WHEN error LIKE 'TABLE_OR%' THEN 'hallucinated_table' ELSE 'other_sql_error' END AS kind FROM r) WHERE kind IS NOT NULL GROUP BY kind"""


def robustness(s, d):
    return evaluation.robustness(samples(s, d).withColumnRenamed("lang", "kind")).select("kind", _r("accuracy"), "n")


def cost_per_model(s, d):
    model = F.element_at(F.array(*map(F.lit, ("4o-mini", "4o", "4.1-mini", "own"))), (F.col("conv_id") % 4 + 1).cast("int"))
    calls = conversations(s, d).select(model.alias("model"), F.length("text").alias("tokens_in"), F.octet_length("text").alias("tokens_out"))
    return evaluation.cost_per_model(calls, "model", "tokens_in", "tokens_out").withColumn("cost", F.round("cost", 8))


COST_SQL = """WITH c AS (SELECT ['4o-mini', '4o', '4.1-mini', 'own'][conv_id % 4 + 1] AS model, length(text) AS i, octet_length(encode(text)) AS o FROM conversations), g AS (SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out FROM c GROUP BY model)
SELECT model, calls, tokens_in, tokens_out, round(tokens_in / 1e6 * CASE model WHEN '4o-mini' THEN 0.15e0 WHEN '4o' THEN 2.5e0 WHEN '4.1-mini' THEN 0.4e0 ELSE 0.0e0 END + tokens_out / 1e6 * CASE model WHEN '4o-mini' THEN 0.6e0 WHEN '4o' THEN 10.0e0 WHEN '4.1-mini' THEN 1.6e0 ELSE 0.0e0 END, 8) AS cost FROM g"""


def break_even(s, d):
    rows = events(s, d).groupBy("event_type").agg(F.lit(0.35).alias("gpu_hour"), (F.count(F.lit(1)) / 60).alias("qps"), F.lit(0.9).alias("api_1k"))
    out = evaluation.serving_costs(rows, "gpu_hour", "qps", "api_1k")
    return out.select("event_type", _r("own_per_1k"), _r("break_even_qps"))


BREAK_SQL = "SELECT event_type, round(0.35e0 / (count(*) / 60.0e0 * 3600.0e0) * 1000.0e0, 6) AS own_per_1k, round(0.35e0 / (0.9e0 / 1000.0e0 * 3600.0e0), 6) AS break_even_qps FROM events GROUP BY event_type"


def throughput(s, d):
    spent = F.max("event_id") - F.min("event_id")
    rows = events(s, d).groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("tokens"), spent.cast("double").alias("seconds"))
    return rows.select("user_id", F.round(evaluation.throughput(F.col("tokens"), F.col("seconds")), 6).alias("rate"))


def trajectory_efficiency(s, d):
    rows = events(s, d).select(
        (F.col("event_id") % 5).alias("calls"), (F.col("event_id") % 3).alias("tool_calls"), (F.col("event_id") % 100).alias("tokens"),
        F.col("value").alias("latency"), (F.col("event_type") == "error").alias("truncated"), "correct",
    )
    out = evaluation.efficiency(rows)
    return out.select("n", *(_r(c) for c in out.columns[1:]))


EFFICIENCY_SQL = """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS p, count(*) OVER () AS n FROM events)
SELECT count(*) AS n, round(avg(event_id % 5), 6) AS mean_calls, round(avg(event_id % 3), 6) AS mean_tool_calls, round(avg(event_id % 100), 6) AS mean_tokens,
 round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS truncated_frac, round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS accuracy,
 round((SELECT min(value) FROM r WHERE p = n // 2), 6) AS p50, round((SELECT min(value) FROM r WHERE p = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1)), 6) AS p95 FROM events"""


def confusion(s, d):
    return evaluation.confusion(samples(s, d).withColumn("p", 1 - F.col("toxic")), "quality", "p").withColumn("agreement", F.round("agreement", 6))


CONFUSION_SQL = f"""WITH {SAMPLES} SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp,
 count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, round(avg(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END), 6) AS agreement FROM x"""


def answers(s, d):
    """Three agents over the labelled items."""
    agents = F.array(F.struct(F.lit("a").alias("agent"), F.col("quality").alias("hit")), F.struct(F.lit("b").alias("agent"), (1 - F.col("toxic")).alias("hit")), F.struct(F.lit("c").alias("agent"), (F.col("doc_id") % 2).cast("int").alias("hit")))
    return t.load(s, d, "labels").select("doc_id", F.explode(agents).alias("x")).select("doc_id", "x.agent", "x.hit")


ANSWERS = "y AS (SELECT doc_id, 'a' AS agent, quality AS hit FROM labels UNION ALL SELECT doc_id, 'b', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'c', CAST(doc_id % 2 AS INTEGER) FROM labels)"


def complementarity(s, d):
    return evaluation.complementarity(answers(s, d), "agent", "doc_id", "hit")


COMPLEMENT_SQL = f"""WITH {ANSWERS} SELECT p.agent AS a, q.agent AS b, count(*) FILTER (WHERE p.hit > q.hit) AS only_a, count(*) FILTER (WHERE q.hit > p.hit) AS only_b,
 count(*) FILTER (WHERE p.hit = 1 AND q.hit = 1) AS both, count(*) FILTER (WHERE p.hit = 0 AND q.hit = 0) AS neither FROM y p JOIN y q ON p.doc_id = q.doc_id WHERE p.agent < q.agent GROUP BY 1, 2"""


def heatmap(s, d):
    return evaluation.heatmap(answers(s, d), "agent", "doc_id", "hit", ["a", "b", "c"])


def pareto(s, d):
    rows = t.load(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 37).alias("cost"), F.round("s_acctbal", 0).alias("value"))
    return evaluation.pareto(rows, "cost", "value")


PARETO_SQL = """WITH r AS (SELECT s_suppkey, s_suppkey % 37 AS cost, round(s_acctbal, 0) AS value FROM supplier)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.cost <= r.cost AND q.value >= r.value AND (q.cost < r.cost OR q.value > r.value))"""


def merge_equality(s, d):
    a = t.load(s, d, "labels").select("doc_id", F.col("quality").alias("correct"))
    b = t.load(s, d, "labels").filter("doc_id % 9 > 0").select("doc_id", (1 - F.col("toxic")).alias("correct"))
    return evaluation.same_decisions(a, b, "doc_id", "correct")


def _shop(s, d):
    return {"customers": t.customers(s, d), "products": t.products(s, d), "orders": t.orders(s, d), "order_items": t.order_items(s, d)}


def slot_pools(s, d):
    return taskgen.slot_values(_shop(s, d)).select("slot", "value")


POOLS_SQL = """SELECT 'city' AS slot, n_name AS value FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
UNION ALL SELECT 'segment', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'category', p_type FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT 'status', o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT DISTINCT 'month', strftime(o_orderdate, '%m') FROM orders"""
#: The domains that grow with the tables, whole.
GROWING = {
    "product_name": "SELECT DISTINCT p_name FROM part",
    "customer_name": "SELECT DISTINCT c_name FROM customer",
    "signup_cut": "SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') FROM orders",
}


def price_thresholds(s, d):
    return taskgen.price_thresholds(t.products(s, d))


THRESHOLDS_SQL = """WITH r AS (SELECT p_retailprice AS price, row_number() OVER (ORDER BY p_retailprice) - 1 AS p, count(*) OVER () AS n FROM part),
q AS (SELECT unnest([0.1e0, 0.25e0, 0.4e0, 0.5e0, 0.6e0, 0.75e0, 0.9e0]) AS f)
SELECT DISTINCT CAST(round_even(price / 100.0e0, 0) * 100 AS BIGINT) AS value FROM r, q WHERE p = CAST(floor(n * f) AS BIGINT)"""


def _all_pools_sql() -> str:
    grown = [f"SELECT '{slot}', * FROM ({sql})" for slot, sql in GROWING.items()]
    fixed = [f"SELECT '{slot}', '{v}'" for slot, values in taskgen.SLOT_CONSTANTS.items() for v in values]
    return " UNION ALL ".join([POOLS_SQL, *grown, f"SELECT 'price_threshold', CAST(value AS VARCHAR) FROM ({THRESHOLDS_SQL})", *fixed])


def family_capacity(s, d):
    return taskgen.capacities(s, taskgen.slot_values(_shop(s, d)))


def _made_sql() -> str:
    grown = [f"SELECT '{slot}', count(*) FROM ({sql})" for slot, sql in GROWING.items()]
    fixed = [f"SELECT '{slot}', {len(values)}" for slot, values in taskgen.SLOT_CONSTANTS.items()]
    sizes = " UNION ALL ".join(["SELECT slot, count(*) AS n FROM pools GROUP BY slot", *grown, f"SELECT 'price_threshold', count(*) FROM ({THRESHOLDS_SQL})", *fixed])
    rows = ", ".join(f"('{x.family}', '{x.level}', {len(x.variants)}, {len(x.openers)}, {list(x.slots)}::VARCHAR[])" for x in taskgen.TEMPLATES)
    return f"""WITH pools AS ({POOLS_SQL}), sizes AS ({sizes}), t(family, level, variants, openers, slots) AS (VALUES {rows}),
made AS (SELECT family, level, openers, CAST(variants * (SELECT coalesce(product(n), 1) FROM sizes WHERE list_contains(t.slots, slot)) AS BIGINT) AS n_golds FROM t)
SELECT"""


_CAPACITY_SQL = f"{_made_sql()} family, level, n_golds * openers AS capacity FROM made"
#: Every opener asks for the same gold, and golds of other slot values differ.
_ENUMERATED_SQL = f"{_made_sql()} family, level, least(n_golds * openers, {taskgen.ENUMERATION_CAP}) AS n, n_golds FROM made"


def enumerate_sizes(s, d):
    values = taskgen.slot_values(_shop(s, d))
    tasks = taskgen.enumerate_tasks(s, values).groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))
    golds = taskgen.instances(s, values).groupBy("family", "level").agg(F.countDistinct("gold").alias("n_golds"))
    return tasks.join(golds, ["family", "level"])


DRAWS = 20


def task_draws(s, d):
    return taskgen.draw_tasks(s, taskgen.slot_values(_shop(s, d)), DRAWS).select("family", "draw", "level", "question", "gold")


def _draws_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    many = lambda xs: "[" + ", ".join(map(text, xs)) + "]::VARCHAR[]"
    keys = sorted({k for x in taskgen.TEMPLATES for v in x.variants for k in v})
    slots = sorted({n for x in taskgen.TEMPLATES for n in x.slots})
    filled = lambda x: [many([v.get(k, "") for v in x.variants]) for k in keys]
    rows = ", ".join(f"({text(x.family)}, {text(x.level)}, {text(x.body)}, {text(x.gold)}, {many(x.slots)}, {many(x.openers)}, {', '.join(filled(x))})" for x in taskgen.TEMPLATES)
    pick = lambda options, of: f"{options}[1 + CAST(concat('0x', substr(md5(concat(said, ':{of}')), 1, 8)) AS BIGINT) % len({options})]"

    def fill(x: str) -> str:
        for k in keys:
            x = f"replace({x}, '{{{k}}}', {pick(f'v_{k}', 'variants')})"
        for n in slots:
            x = f"replace({x}, '{{{n}}}', coalesce(s_{n}, ''))"
        return x

    chosen = ", ".join(f"max(value) FILTER (slot = '{n}') AS s_{n}" for n in slots)
    return f"""WITH pools AS ({_all_pools_sql()}), t(family, level, body, gold, slots, openers, {', '.join(f'v_{k}' for k in keys)}) AS (VALUES {rows}),
w AS (SELECT *, concat('1234:', draw, ':', family) AS said FROM t, range({DRAWS}) r(draw)),
f AS (SELECT family, draw, slot, arg_min(value, md5(concat(said, ':', slot, ':', value))) AS value FROM (SELECT family, draw, said, unnest(slots) AS wanted FROM w) x JOIN pools ON slot = wanted GROUP BY 1, 2, 3),
g AS (SELECT family, draw, {chosen} FROM f GROUP BY 1, 2)
SELECT w.family, CAST(w.draw AS INTEGER) AS draw, level, {fill(f"replace({pick('openers', 'openers')}, '{{body}}', body)")} AS question, {fill('gold')} AS gold
FROM w LEFT JOIN g ON g.family = w.family AND g.draw = w.draw"""


def folded_golds(s, d):
    """Facts of the gold of every instance of every template over the whole tables."""
    shop = _shop(s, d)
    taskgen.register(s, shop)
    return taskgen.folded_golds(s, cut(taskgen.slot_values(shop))).select("gold", "n_rows", F.col("all_null").cast("int").alias("all_null"), F.col("error").isNotNull().cast("int").alias("failed"))


def _folded_sql() -> str:
    """Each template's gold as a correlated subquery over its slots' domains."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    value = {"price_threshold": "CAST(p_price_threshold.value AS DOUBLE)", "signup_cut": "CAST(p_signup_cut.value AS TIMESTAMP)"}
    parts = []
    for x in taskgen.TEMPLATES:
        for variant in x.variants:
            gold = x.gold
            for k, v in variant.items():
                gold = gold.replace(f"{{{k}}}", v)
            fixed = [k for k in x.slots if k in taskgen.SLOT_CONSTANTS]
            for chosen in product(*(taskgen.SLOT_CONSTANTS[k] for k in fixed)):
                shown, ran = gold, gold.replace("date_format", "strftime").replace("'MM'", "'%m'")
                for k, v in zip(fixed, chosen, strict=True):
                    shown, ran = shown.replace(f"{{{k}}}", str(v)), ran.replace(f"{{{k}}}", str(v))
                shown = text(shown)
                free = [k for k in x.slots if k not in fixed]
                for k in free:
                    shown = f"replace({shown}, '{{{k}}}', p_{k}.value)"
                    ran = ran.replace(f"'{{{k}}}'", f"{{{k}}}").replace(f"{{{k}}}", value.get(k, f"p_{k}.value"))
                pools = "".join(f", (SELECT value FROM pools WHERE slot = '{k}') AS p_{k}" for k in free)
                filled = f"(SELECT count(*) FROM (SELECT to_json(r) AS j FROM ({ran}) AS r) WHERE regexp_matches(j, ':[^n]'))"
                parts.append(f"SELECT {shown} AS gold, (SELECT count(*) FROM ({ran})) AS n_rows, {filled} AS filled FROM (SELECT 1){pools}")
    return f"""{SHOP}, pools AS ({_all_pools_sql()}), made AS ({" UNION ALL ".join(parts)})
SELECT gold, n_rows, CAST(n_rows = 1 AND filled = 0 AS INTEGER) AS all_null, 0 AS failed FROM made"""


# ---- Generated tasks: documents are questions, their sources families; facts of golds by id ----
GOLD = "CASE WHEN doc_id % 10 = 0 THEN concat('drop ', CAST(doc_id AS VARCHAR(20))) ELSE concat('  Select ', CAST(doc_id AS VARCHAR(20))) END"
RULE = "CASE doc_id % 13 WHEN 0 THEN 'rule1_exact_question' WHEN 1 THEN 'signature_only' END"


def made_tasks(s, d):
    docs = t.load(s, d, "documents")
    tasks = docs.selectExpr("doc_id", "source AS family", "text AS question", f"{GOLD} AS gold", "doc_id % 5 < 3 AS multi_row", f"{RULE} AS rule", "doc_id AS order")
    facts = docs.filter("doc_id % 17 > 0").selectExpr(f"{GOLD} AS gold", "CASE WHEN doc_id % 7 = 0 THEN 'NOT_FOUND' END AS error", "CASE WHEN doc_id % 11 > 0 THEN doc_id % 4 END AS n_rows", "doc_id % 4 = 1 AND doc_id % 3 = 0 AS all_null")
    return taskgen.validated(tasks, facts)


MADE = f"""v AS (SELECT doc_id, source AS family, text AS question, {RULE} AS rule, CASE WHEN doc_id % 10 = 0 THEN 'not_select' WHEN doc_id % 17 = 0 THEN 'gold_none' WHEN doc_id % 7 = 0 THEN 'gold_error:NOT_FOUND'
 WHEN doc_id % 11 = 0 THEN 'gold_none' WHEN doc_id % 4 = 0 THEN 'empty_result' WHEN doc_id % 12 = 9 THEN 'all_null_result' WHEN doc_id % 4 = 1 AND doc_id % 5 < 3 THEN 'degenerate_single_row' ELSE 'ok' END AS reason FROM documents)"""


def validated_tasks(s, d):
    return made_tasks(s, d).select("doc_id", "reason")


def accepted_tasks(s, d):
    return taskgen.corpus(made_tasks(s, d)).select("doc_id", "family")


def rejection_counts(s, d):
    return taskgen.audit_counts(made_tasks(s, d))


_ACCEPTED_SQL = f"""WITH {MADE}, r AS (SELECT doc_id, family, row_number() OVER (PARTITION BY family, {NORM.format(x='question')} ORDER BY doc_id) AS p FROM v WHERE reason = 'ok' AND (rule IS NULL OR rule = 'signature_only'))
SELECT doc_id, family FROM r WHERE p = 1"""
_REJECTED_SQL = f"""WITH {MADE}, w AS (SELECT family, CASE WHEN reason <> 'ok' THEN reason ELSE coalesce(rule, 'accepted') END AS why FROM v) SELECT family, why, count(*) AS n FROM w GROUP BY CUBE (family, why)"""

_STAR_YIELD = f"WITH {SAMPLES}, g AS (SELECT lang, source, max(CAST(correct AS INTEGER)) AS hit FROM x GROUP BY 1, 2) SELECT lang, CAST(sum(hit) AS BIGINT) AS kept, count(*) AS tasks, round(sum(hit) * 1.0e0 / count(*), 3) AS yield FROM g GROUP BY lang"

QUERIES = {
    "advantage": (advantage, f"WITH {MOMENTS} SELECT event_id, round(CASE WHEN std < 1e-4 THEN 0.0e0 ELSE (value - mean) / (std + 1e-4) END, 5) AS advantage FROM events JOIN m ON m.user_id = events.user_id"),
    "advantage_unscaled": (advantage_unscaled, f"WITH {MOMENTS} SELECT event_id, round(value - mean, 5) AS advantage FROM events JOIN m ON m.user_id = events.user_id"),
    "group_summary": (group_summary, GROUP_SQL),
    "learnable_band": (learnable_band, "SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS pass_rate FROM events GROUP BY user_id HAVING avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) BETWEEN 0.125e0 AND 0.22e0"),
    "probe_band": (probe_band, "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') / 100.0e0, 6) AS probe_rate FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') / 100.0e0 BETWEEN 0.125e0 AND 0.22e0"),
    "pass_at_k": (pass_at_k, "SELECT round(avg(hit), 6) AS pass_at_k FROM (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p <= 4 GROUP BY user_id)"),
    "zero_adv_fraction": (zero_advantage_fraction, "SELECT round(avg(CASE WHEN k <= 1 THEN 1 ELSE 0 END), 6) AS zero_advantage_fraction FROM (SELECT conv_id, count(DISTINCT floor(length(text) / 4000.0e0)) AS k FROM conversations GROUP BY conv_id)"),
    "episode_pairs": (episode_pairs, EPISODE_SQL),
    "assistant_spans": (lambda s, d: trajectories.assistant_spans(conversations(s, d)), f'WITH {OFFSETS} SELECT conv_id, turn, start, stop AS "end" FROM o WHERE role = \'assistant\''),
    "mask_lengths": (mask_lengths, MASK_SQL),
    "turns_per_episode": (lambda s, d: trajectories.turns_per_episode(conversations(s, d)), "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id"),
    "episode_replay": (replay, REPLAY_SQL),
    "rollout_steps": (rollout_steps, ROLLOUT_SQL),
    "reward_bounds": (reward_bounds, BOUNDS_SQL),
    "training_history": (training_history, HISTORY_SQL),
    "sft_rows": (sft_rows, _sft_sql()),
    "chart_series": (chart_series, CHART_SQL),
    "filled_history": (filled_history, FILLED_SQL),
    "validation_gate": (validation_gate, GATE_SQL),
    "pathology_checks": (pathologies, PATHOLOGY_SQL),
    "star_sample": (star_sample, STAR_SQL),
    "star_first": (star_first, f"WITH {SAMPLES} SELECT source, md5(arg_min(text, doc_id)) AS sql FROM x GROUP BY source"),
    "star_yield": (star_yield, _STAR_YIELD),
    "ablation_arms": (ablation_arms, ARMS_SQL),
    "eval_by_level": (eval_by_level, f"WITH {SAMPLES} SELECT lang, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM x GROUP BY ROLLUP (lang)"),
    "wilson": (wilson, f"WITH {LEVELS} SELECT lang, round(greatest(0.0e0, {WILSON} - {HALF}), 6) AS low, round(least(1.0e0, {WILSON} + {HALF}), 6) AS high FROM g"),
    "report_number": (report_number, REPORT_SQL),
    "mcnemar_counts": (mcnemar_counts, MCNEMAR_SQL),
    "mcnemar_test": (mcnemar_test, MCNEMAR_P_SQL),
    "correctness_vector": (lambda s, d: evaluation.correctness_vector(samples(s, d), "doc_id"), f"WITH {SAMPLES} SELECT doc_id, CAST(correct AS INTEGER) AS hit FROM x"),
    "external_metrics": (external_metrics, "SELECT event_id, value AS m_value, CAST(event_id % 4 AS DOUBLE) AS m_turns, CAST(event_id % 3 AS DOUBLE) AS m_calls FROM events"),
    "folded_golds": (folded_golds, _folded_sql()),
    "episode_stream": (episode_stream, REPLAY_SQL),
    "validated_tasks": (validated_tasks, f"WITH {MADE} SELECT doc_id, reason FROM v"),
    "accepted_tasks": (accepted_tasks, _ACCEPTED_SQL),
    "rejection_counts": (rejection_counts, _REJECTED_SQL),
    "bootstrap_means": (bootstrap_means, BOOT_SQL),
    "paired_interval": (paired_interval, INTERVAL_SQL),
    "paired_interval_counts": (paired_interval_counts, None),
    "seed_summary": (seed_summary, SEED_SQL),
    "p50_p95": (p50_p95, P_SQL),
    "error_taxonomy": (error_taxonomy, TAXONOMY_SQL),
    "robustness": (robustness, f"WITH {SAMPLES} SELECT lang AS kind, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, count(*) AS n FROM x GROUP BY lang"),
    "cost_per_model": (cost_per_model, COST_SQL),
    "break_even": (break_even, BREAK_SQL),
    "throughput": (throughput, "SELECT user_id, CASE WHEN max(event_id) > min(event_id) THEN round(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / (max(event_id) - min(event_id)), 6) ELSE 0.0e0 END AS rate FROM events GROUP BY user_id"),
    "trajectory_efficiency": (trajectory_efficiency, EFFICIENCY_SQL),
    "confusion": (confusion, CONFUSION_SQL),
    "complementarity": (complementarity, COMPLEMENT_SQL),
    "correctness_heatmap": (heatmap, f"WITH {ANSWERS} SELECT doc_id, max(CASE WHEN agent = 'a' THEN hit END) AS a, max(CASE WHEN agent = 'b' THEN hit END) AS b, max(CASE WHEN agent = 'c' THEN hit END) AS c FROM y GROUP BY doc_id"),
    "pareto": (pareto, PARETO_SQL),
    "merge_equality": (merge_equality, "SELECT count(*) FILTER (WHERE doc_id % 9 = 0 OR quality <> 1 - toxic) AS n_different FROM labels"),
    "slot_pools": (slot_pools, _all_pools_sql()),
    "price_thresholds": (price_thresholds, THRESHOLDS_SQL),
    "family_capacity": (family_capacity, _CAPACITY_SQL),
    "task_draws": (task_draws, _draws_sql()),
    "enumerate_sizes": (enumerate_sizes, _ENUMERATED_SQL),
    "tumbling_counts": (ev.tumbling_counts, "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2"),
    "session_counts": (ev.session_counts, "SELECT user_id, count(*) FILTER (WHERE b IS NULL OR ts >= b + INTERVAL 30 MINUTE) AS sessions, count(*) AS events FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY user_id"),
    "property_sums": (ev.property_sums, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type"),
}
