"""Queries over texts: parsing, guards, tokens, contamination, perturbation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.functions import text as tx
from proofset.operators import contamination, rewards, splits
from proofset.sources import tables as t

#: Completions of many shapes, by document id; the text is the same in both engines.
COMPLETION = """CASE WHEN doc_id % 11 = 0 THEN NULL
 WHEN doc_id % 8 = 0 THEN concat('```sql', chr(10), 'SELECT name FROM part WHERE p_size > ', CAST(doc_id AS VARCHAR(20)), ';', chr(10), '```')
 WHEN doc_id % 8 = 1 THEN 'SQL: SELECT o_orderkey FROM orders WHERE o_custkey = 1; SELECT 2'
 WHEN doc_id % 8 = 2 THEN concat('Here you go: ```select * from orders limit 1``` which should be ', 'just what you asked me for, I think.')
 WHEN doc_id % 8 = 3 THEN 'DROP TABLE orders'
 WHEN doc_id % 8 = 4 THEN '```sql SELECT 1```  ```SELECT 2```'
 WHEN doc_id % 8 = 5 THEN '  '
 WHEN doc_id % 8 = 6 THEN 'SELECT * FROM orders LIMIT 5'
 ELSE concat('((SELECT o.o_orderkey AS k FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey); DELETE ', 'FROM orders') END"""

_B = r"[\x20\x09-\x0D\x1C-\x1F]"
_FENCE = r"(?is)```(?:sql)?\s*(.*?)```"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


COMPLETIONS_SQL = f"WITH c AS (SELECT doc_id, {COMPLETION} AS completion FROM documents), "
_WHOLE = _strip_sql("coalesce(completion, '')")
PARSED_SQL = rf"""{COMPLETIONS_SQL} w AS (SELECT doc_id, completion, {_WHOLE} AS whole FROM c),
i AS (SELECT doc_id, completion, regexp_replace(CASE WHEN regexp_matches(whole, '{_FENCE}') THEN {_strip_sql(f"regexp_extract(whole, '{_FENCE}', 1)")} ELSE whole END,
  '(?i)^{_B}*sql{_B}*:{_B}*', '') AS inner_text FROM w),
p AS (SELECT doc_id, completion, {_strip_sql("CASE WHEN contains(inner_text, ';') THEN concat(split_part(inner_text, ';', 1), ';') ELSE inner_text END")} AS sql_text FROM i)
"""


def completions(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "documents").select("doc_id", F.expr(COMPLETION).alias("completion"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return completions(s, d).withColumn("sql_text", tx.extract_statement(F.col("completion")))


def parse_completion(s: SparkSession, d: str) -> DataFrame:
    return parsed(s, d).select("doc_id", "sql_text")


def format_score(s: SparkSession, d: str) -> DataFrame:
    return completions(s, d).select("doc_id", tx.format_score(F.col("completion")).alias("score"))


def guard_flags(s: SparkSession, d: str) -> DataFrame:
    q = F.coalesce(F.col("completion"), F.lit(""))
    flag = lambda c: c.cast("int")
    return completions(s, d).select(
        "doc_id", flag(tx.is_write(q)).alias("is_write"), flag(tx.is_read_only(q)).alias("is_read_only"), flag(tx.looks_like_select(q)).alias("is_select")
    )


_VERBS, _WORDS = "|".join(tx.WRITE_VERBS), "|".join(tx.FORBIDDEN)
_HEAD = f"lower(regexp_replace({_strip_sql('q')}, '^\\(+', ''))"
GUARD_SQL = rf"""{COMPLETIONS_SQL} x AS (SELECT doc_id, coalesce(completion, '') AS q FROM c),
y AS (SELECT doc_id, q, {_HEAD} AS head, split_part(q, '--', 1) AS body,
  list_filter(list_transform(string_split(q, ';'), lambda z: lower({_strip_sql('z')})), lambda z: z <> '') AS parts FROM x)
SELECT doc_id,
  CAST(regexp_matches(head, '^(?:{_VERBS})') OR len(list_filter(parts[2:], lambda z: regexp_matches(z, '^(?:{_VERBS})'))) > 0 AS INTEGER) AS is_write,
  CAST(regexp_matches(head, '^(?:select|with)')
    AND (length(body) - length(replace(body, ';', '')) = 0 OR (length(body) - length(replace(body, ';', '')) = 1 AND regexp_matches(body, ';{_B}*$')))
    AND NOT regexp_matches(concat(' ', head, ' '), ' (?:{_WORDS}) ') AS INTEGER) AS is_read_only,
  CAST(regexp_matches(head, '^(?:select|with)') AS INTEGER) AS is_select
FROM y"""

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\"''`]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS = "list_filter(list_distinct(string_split({n}, ' ')), lambda w: w <> '' AND NOT list_contains([{stop}], w) AND NOT regexp_matches(w, '^[0-9]+$'))"


def _tokens_sql(x: str) -> str:
    return TOKENS.format(n=NORM.format(x=x), stop=STOP)


def norm_text(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "documents").select("doc_id", F.md5(tx.norm_question(F.col("text"))).alias("norm"))


def token_count(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "documents").select("doc_id", F.size(tx.content_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def canon_key(s: SparkSession, d: str) -> DataFrame:
    return parsed(s, d).select("doc_id", tx.canonical_sql(F.col("sql_text")).alias("canon"))


CANON_SQL = rf"""{PARSED_SQL}, a AS (SELECT doc_id, regexp_replace(regexp_replace({_strip_sql("sql_text")}, ';+$', ''), '\s+', ' ', 'g') AS x FROM p)
SELECT doc_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\bAS\s+\w+', '', 'g'), '(?i)\b([a-z]{{1,3}})\.', '', 'g'),
  '(?i)\b(JOIN\s+\w+)\s+[a-z]{{1,3}}\b', '\1', 'g'), '(?i)\b(FROM\s+\w+)\s+[a-z]{{1,3}}\b', '\1', 'g'), '\s+', ' ', 'g'))) AS canon FROM a"""


def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return contamination.first_by_key(t.load(s, d, "documents"), tx.dedup_key(F.col("text")), "doc_id").select("doc_id")


def _sentences(df: DataFrame, key: str, name: str) -> DataFrame:
    rows = df.select(key, F.posexplode(F.split("text", r"\. |\n")).alias("place", "text"))
    return rows.select((F.col(key) * (1 << 20) + F.col("place")).alias(name), "text")


def document_sentences(s: SparkSession, d: str) -> DataFrame:
    """(id, text) of the sentences of documents: id is doc_id * 2^20 + place."""
    return _sentences(t.load(s, d, "documents"), "doc_id", "id")


def held_out_sentences(s: SparkSession, d: str) -> DataFrame:
    return _sentences(t.load(s, d, "benchmark"), "item_id", "item")


def held_out(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "benchmark").select(F.col("item_id").alias("item"), "text")


def _sentences_sql(table: str, key: str, name: str) -> str:
    parts = f"SELECT {key}, regexp_split_to_array(text, '\\. |\\n') AS parts FROM {table}"
    return f"SELECT {key} * 1048576 + i - 1 AS {name}, parts[i] AS text FROM (SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS i FROM ({parts}))"


LINES_SQL = f"lines AS ({_sentences_sql('documents', 'doc_id', 'id')}), items AS ({_sentences_sql('benchmark', 'item_id', 'item')})"


def leak_rule1(s: SparkSession, d: str) -> DataFrame:
    return contamination.exact_questions(document_sentences(s, d), held_out_sentences(s, d))


def leak_rule2(s: SparkSession, d: str) -> DataFrame:
    return contamination.near_questions(document_sentences(s, d), held_out_sentences(s, d)).select("id", "item", F.round("jaccard", 6).alias("jaccard"))


def leak_containment(s: SparkSession, d: str) -> DataFrame:
    docs = t.load(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return contamination.containment(docs, held_out(s, d)).select("id", "item", F.round("contained", 6).alias("contained"))


_ITEMS = f"b AS (SELECT item_id AS item, {_tokens_sql('text')} AS tb FROM benchmark)"
_MET = "SELECT a.id, b.item, len(ta) AS na, len(tb) AS nb, len(list_intersect(ta, tb)) AS k FROM a, b WHERE len(ta) > 0 AND len(tb) > 0"
#: Two empty sets are equal; all items without tokens are one class, and the first stands for it.
_EMPTY = "(SELECT min(item) AS item FROM b WHERE len(tb) = 0 HAVING count(*) > 0)"
RULE2_SQL = f"""WITH {LINES_SQL}, a AS (SELECT id, {_tokens_sql('text')} AS ta FROM lines), b AS (SELECT item, {_tokens_sql('text')} AS tb FROM items),
m AS ({_MET} AND len(ta) >= 0.85 * len(tb) AND len(tb) >= 0.85 * len(ta))
SELECT id, item, round(k * 1.0e0 / (na + nb - k), 6) AS jaccard FROM m WHERE k * 1.0e0 / (na + nb - k) >= 0.85
UNION ALL SELECT a.id, e.item, 1.0e0 FROM a, {_EMPTY} AS e WHERE len(ta) = 0"""
CONTAIN_SQL = f"""WITH a AS (SELECT doc_id AS id, {_tokens_sql('text')} AS ta FROM documents), {_ITEMS}, m AS ({_MET})
SELECT id, item, round(k * 1.0e0 / nb, 6) AS contained FROM m WHERE k * 1.0e0 / nb >= 0.85"""


def leak_audit(s: SparkSession, d: str) -> DataFrame:
    """Documents by language and by whether a held-out item is contained in them, with totals."""
    docs = t.load(s, d, "documents")
    hit = contamination.containment(docs.select(F.col("doc_id").alias("id"), "text"), held_out(s, d)).select(F.col("id").alias("doc_id")).distinct()
    marked = docs.join(hit.withColumn("hit", F.lit("contained")), "doc_id", "left").withColumn("rule", F.coalesce("hit", F.lit("clean")))
    return marked.rollup("lang", "rule").agg(F.count(F.lit(1)).alias("n"))


AUDIT_SQL = f"""WITH a AS (SELECT doc_id AS id, {_tokens_sql('text')} AS ta FROM documents), {_ITEMS}, m AS ({_MET}),
h AS (SELECT DISTINCT id FROM m WHERE k * 1.0e0 / nb >= 0.85),
d AS (SELECT lang, CASE WHEN h.id IS NULL THEN 'clean' ELSE 'contained' END AS rule FROM documents LEFT JOIN h ON h.id = doc_id)
SELECT lang, rule, count(*) AS n FROM d GROUP BY ROLLUP (lang, rule)"""

#: Golds by id, written in two ways, and signatures by the first characters.
GOLDS = {"id": "concat('select a.x  from t', CAST(id % 5003 AS STRING), ' a;')", "item": "concat('SELECT x FROM t', CAST(item % 5003 AS STRING))"}
SIGNATURE = "substring(text, 1, 3)"


def contamination_audit(s: SparkSession, d: str) -> DataFrame:
    """Rules 1 to 4 by precedence over all sentences of documents and held-out items."""
    candidates = document_sentences(s, d).selectExpr("id", "text", f"{GOLDS['id']} AS gold", f"{SIGNATURE} AS signature")
    items = held_out_sentences(s, d).selectExpr("item", "item AS position", "text", f"{GOLDS['item']} AS gold", f"{SIGNATURE} AS signature")
    return contamination.audit(candidates, items).select("id", F.coalesce("rule", F.lit("clean")).alias("rule"))


RULES_SQL = f"""WITH {LINES_SQL},
a AS (SELECT id, {SIGNATURE} AS sig, {NORM.format(x='text')} AS n, {_tokens_sql('text')} AS ta FROM lines),
b AS (SELECT item, {SIGNATURE} AS sig, {NORM.format(x='text')} AS n, {_tokens_sql('text')} AS tb FROM items),
m AS ({_MET} AND len(ta) >= 0.85 * len(tb) AND len(tb) >= 0.85 * len(ta)),
r2 AS (SELECT DISTINCT id FROM m WHERE k * 1.0e0 / (na + nb - k) >= 0.85 UNION SELECT a.id FROM a, {_EMPTY} AS e WHERE len(ta) = 0),
f AS (SELECT sig, min(item) AS item FROM b GROUP BY sig),
r4 AS (SELECT a.id, len(list_intersect(ta, tb)) AS k, len(ta) + len(tb) AS both FROM a JOIN f ON f.sig = a.sig JOIN b ON b.item = f.item)
SELECT a.id, CASE WHEN a.n IN (SELECT n FROM b) THEN 'rule1_exact_question' WHEN r2.id IS NOT NULL THEN 'rule2_near_duplicate_question'
 WHEN a.id % 5003 IN (SELECT item % 5003 FROM b) THEN 'rule3_canonical_sql' WHEN r4.both = 0 OR r4.k * 1.0e0 / (r4.both - r4.k) >= 0.5 THEN 'rule4_result_and_question'
 WHEN r4.id IS NOT NULL THEN 'signature_only' ELSE 'clean' END AS rule FROM a LEFT JOIN r2 ON r2.id = a.id LEFT JOIN r4 ON r4.id = a.id"""

#: Questions of many shapes, by customer.
QUESTION = """CASE c_custkey % 7
 WHEN 0 THEN concat('List the names of all customers in ', c_mktsegment, '. List products too.')
 WHEN 1 THEN 'Show the category of all products and the customers'
 WHEN 2 THEN concat('How many orders have segment ', c_mktsegment, '?')
 WHEN 3 THEN 'What is the total? Return the name and return the price '
 WHEN 4 THEN 'find customer orders by Category'
 WHEN 5 THEN 'Return only the customers, products and Customers'
 ELSE 'Which product sells? Return the product.' END"""


def questions(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "customer").select("c_custkey", F.expr(QUESTION).alias("q"))


def _paraphrase_sql() -> str:
    out = "q"
    for pattern, to in tx.PARAPHRASES:
        out = f"regexp_replace({out}, '{pattern}', '{to}')"
    return f"SELECT c_custkey, concat(upper(substring(x, 1, 1)), substring(x, 2)) AS q FROM (SELECT c_custkey, {out} AS x FROM (SELECT c_custkey, {QUESTION} AS q FROM customer))"


def _rename_sql() -> str:
    out = "q"
    for pattern, to in tx.RENAMES:
        out = f"regexp_replace({out}, '(?i){pattern}', '{to}', 'g')"
    return f"SELECT c_custkey, {out} AS q FROM (SELECT c_custkey, {QUESTION} AS q FROM customer)"


_PICK = "CAST(('0x' || substring(md5(CAST(c_custkey AS VARCHAR)), 1, 6)) AS BIGINT) % 5 + 1"
DISTRACT_SQL = rf"""SELECT c_custkey, concat(regexp_replace(q, '\s+$', ''), [{", ".join(f"'{x}'" for x in tx.DISTRACTORS)}][{_PICK}]) AS q
FROM (SELECT c_custkey, {QUESTION} AS q FROM customer)"""


def perturb_typo(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("c_custkey", tx.typo(F.col("q"), F.col("c_custkey")).alias("q"))


def _drawn_sql(salt: int) -> str:
    return f"CAST(concat('0x', substring(md5(concat_ws(':', c_custkey, i, {salt})), 1, 6)) AS INTEGER)"


TYPO_SQL = f"""WITH q AS (SELECT c_custkey, string_split({QUESTION}, ' ') AS words FROM customer),
w AS (SELECT c_custkey, unnest(words) AS w, unnest(range(len(words))) AS i FROM q),
f AS (SELECT *, regexp_matches(w, '^[a-z]') AND NOT contains(w, chr(39)) AND length(trim(w, concat('.,?', chr(39)))) > 4 AS fit FROM w),
r AS (SELECT *, fit AND row_number() OVER (PARTITION BY c_custkey, fit ORDER BY {_drawn_sql(1)}, i) <= 2 AS hit FROM f),
p AS (SELECT *, CASE WHEN hit THEN 2 + {_drawn_sql(2)} % (length(w) - 2) END AS spot FROM r),
n AS (SELECT *, MAP {{{", ".join(f"'{a}': '{b}'" for a, b in tx.NEIGHBOUR_KEYS.items())}}}[lower(w[spot:spot])] AS other FROM p)
SELECT c_custkey, string_agg(CASE WHEN NOT hit THEN w
    WHEN other IS NOT NULL AND {_drawn_sql(3)} % 2 = 0 THEN concat(w[:spot - 1], other, w[spot + 1:])
    ELSE concat(w[:spot - 1], w[spot + 1:spot + 1], w[spot:spot], w[spot + 2:]) END, ' ' ORDER BY i) AS q
FROM n GROUP BY c_custkey"""


def _apply(fn, *more: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return questions(s, d).select("c_custkey", fn(F.col("q"), *map(F.col, more)).alias("q"))

    return run


# ---- Splits over documents: family is the source, level the language ----------
ORDER = "md5(concat('1234:', CAST(doc_id AS VARCHAR))), doc_id"
MIX = [("en", 0.40), ("fr", 0.30), ("de", 0.30)]
N_ALLOCATED = 240


def balanced_take(s: SparkSession, d: str) -> DataFrame:
    return splits.balanced_take(t.load(s, d, "documents"), 100, "source", "doc_id").select("doc_id", "source")


def allocate(s: SparkSession, d: str) -> DataFrame:
    return splits.allocate(t.load(s, d, "documents"), N_ALLOCATED, MIX, "source", "lang", "doc_id").select("doc_id", "source", "lang")


def _allocate_sql() -> str:
    ctes = ["docs AS (SELECT doc_id, source, lang FROM documents)", "cap AS (SELECT greatest(CAST(floor(240.0e0 / count(DISTINCT source) * 2.5e0) AS BIGINT), 4) AS cap FROM documents)"]
    picked: list[str] = []
    for i, (lang, share) in enumerate(MIX):
        before = " UNION ALL ".join(f"SELECT source FROM p{j}" for j in range(i)) or "SELECT source FROM docs WHERE 1 = 0"
        ctes.append(f"t{i} AS (SELECT source, count(*) AS n FROM ({before}) GROUP BY source)")
        ctes.append(f"r{i} AS (SELECT doc_id, docs.source, lang, row_number() OVER (PARTITION BY docs.source ORDER BY {ORDER}) + coalesce(t{i}.n, 0) AS turn FROM docs LEFT JOIN t{i} ON t{i}.source = docs.source WHERE lang = '{lang}')")
        ctes.append(f"p{i} AS (SELECT doc_id, source, lang FROM r{i} WHERE turn <= (SELECT cap FROM cap) ORDER BY turn, source LIMIT {round(N_ALLOCATED * share)})")
        picked.append(f"SELECT * FROM p{i}")
    done = " UNION ALL ".join(picked)
    ctes.append(f"done AS ({done})")
    ctes.append("t9 AS (SELECT source, count(*) AS n FROM done GROUP BY source)")
    ctes.append(f"r9 AS (SELECT doc_id, docs.source, lang, row_number() OVER (PARTITION BY docs.source ORDER BY {ORDER}) + coalesce(t9.n, 0) AS turn FROM docs LEFT JOIN t9 ON t9.source = docs.source WHERE doc_id NOT IN (SELECT doc_id FROM done))")
    ctes.append(f"p9 AS (SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (ORDER BY turn, source) AS place FROM r9 WHERE turn <= (SELECT cap FROM cap)) WHERE place <= {N_ALLOCATED} - (SELECT count(*) FROM done))")
    return f"WITH {', '.join(ctes)} SELECT * FROM done UNION ALL SELECT * FROM p9"


def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(t.load(s, d, "documents"), 0.2, "lang", "doc_id").select("doc_id", "lang", "split")


def split_disjoint(s: SparkSession, d: str) -> DataFrame:
    dealt = splits.stratified_split(t.load(s, d, "documents"), 0.2, "lang", "doc_id")
    return splits.overlap_count(dealt.filter("split = 'val'"), dealt.filter("split = 'train'"), "doc_id")


def review_sample(s: SparkSession, d: str) -> DataFrame:
    return splits.one_per_family(t.load(s, d, "documents"), "source", "doc_id").select("doc_id", "source")


def split_report(s: SparkSession, d: str) -> DataFrame:
    return splits.split_report(t.load(s, d, "documents"), "lang", "source", "text")


def hack_flags(s: SparkSession, d: str) -> DataFrame:
    flags = rewards.hack_flags(F.col("sql_text"))
    return parsed(s, d).agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(n) for n, c in flags.items()))


def mode_share(s: SparkSession, d: str) -> DataFrame:
    report = rewards.hack_report(completions(s, d))
    return report.select("n", "distinct_sql", "most_common_sql", "most_common_frac", "answer_collapse", F.col("suspicious").cast("int").alias("suspicious"))


def key_nouns(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("c_custkey", tx.key_nouns(F.col("q")).alias("nouns"))


# ---- Rewards: execution facts by document id -----------------------------------
FACTS = "doc_id % 5 = 0 AS correct, doc_id % 8 IN (0, 1, 2, 6) AS executes, CAST(doc_id % 70 AS BIGINT) AS n_rows, CAST(doc_id % 4 AS BIGINT) AS calls"


def facts(s: SparkSession, d: str) -> DataFrame:
    return t.load(s, d, "documents").selectExpr(
        "doc_id", f"{COMPLETION} AS completion", "'Which orders and customer orders have the largest name' AS question",
        "doc_id % 5 = 0 AS correct", "doc_id % 8 IN (0, 1, 2, 6) AS executes", "CAST(doc_id % 70 AS BIGINT) AS n_rows", "CAST(doc_id % 4 AS BIGINT) AS calls",
    )


def composite_reward(s: SparkSession, d: str) -> DataFrame:
    return rewards.composite(facts(s, d)).select("doc_id", F.round("reward", 6).alias("reward"))


def proxy_reward(s: SparkSession, d: str) -> DataFrame:
    return rewards.proxy(facts(s, d)).select("doc_id", F.round("proxy", 6).alias("proxy"))


_FMT = rf"CASE WHEN len(regexp_extract_all(coalesce(completion, ''), '{_FENCE}')) <> 1 THEN 0.0e0 WHEN length({_strip_sql(f'''regexp_replace(coalesce(completion, ''), '{_FENCE}', '', 'g')''')}) > 40 THEN 0.5e0 ELSE 1.0e0 END"
_IS_WRITE = rf"(regexp_matches(lower(regexp_replace({_strip_sql('sql_text')}, '^\(+', '')), '^(?:{_VERBS})'))"
COMPOSITE_SQL = f"""{PARSED_SQL}, f AS (SELECT doc_id, {_FMT} AS fmt, CASE WHEN {_IS_WRITE} THEN 1 ELSE 0 END AS unsafe, {FACTS} FROM p),
g AS (SELECT doc_id, unsafe, CAST(correct AS DOUBLE) * 1.0e0 + fmt * 0.15e0 + CAST(executes AS DOUBLE) * 0.1e0 + CAST(executes AND n_rows > 0 AS DOUBLE) * 0.05e0
  - CAST(greatest(calls - 1, 0) AS DOUBLE) * 0.05e0 AS total FROM f)
SELECT doc_id, round(greatest(-0.2e0, least(1.35e0, CASE WHEN unsafe > 0 THEN least(total, 0.0e0) ELSE total END)), 6) AS reward FROM g"""
_ASKED = "['orders', 'customer', 'have', 'largest', 'name']"
PROXY_SQL = f"""{PARSED_SQL}, f AS (SELECT doc_id, sql_text, {FACTS} FROM p)
SELECT doc_id, CASE WHEN sql_text = '' THEN 0.0e0 ELSE round(least(1.0e0, CASE WHEN executes THEN 0.4e0 + CASE WHEN n_rows BETWEEN 1 AND 50 THEN 0.3e0 ELSE 0.0e0 END ELSE 0.0e0 END
  + 0.3e0 * (len(list_intersect(list_distinct(regexp_extract_all(lower(sql_text), '[a-z_]{{4,}}')), {_ASKED})) / 5.0e0)), 6) END AS proxy FROM f"""
_FLAGS = r"""count(*) FILTER (WHERE low = '') AS empty,
  count(*) FILTER (WHERE low <> '' AND NOT contains(low, ' from ')) AS no_from_clause,
  count(*) FILTER (WHERE low <> '' AND regexp_matches(low, 'select\s+\*')) AS select_star,
  count(*) FILTER (WHERE low <> '' AND regexp_matches(low, '\blimit\s+1\b') AND NOT contains(low, 'order by')) AS degenerate_limit,
  count(*) FILTER (WHERE low <> '' AND NOT contains(low, ' where ') AND NOT contains(low, ' join ')) AS no_where_no_join"""
MODE_SQL = rf"""{PARSED_SQL}, k AS (SELECT lower(trim(regexp_replace(sql_text, '\s+', ' ', 'g'))) AS key, count(*) AS times FROM p WHERE sql_text <> '' GROUP BY 1),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE sql_text <> '' AND NOT contains(lower(sql_text), ' from ')) AS nf FROM p),
top AS (SELECT key, times FROM k ORDER BY times DESC, key LIMIT 1)
SELECT n, (SELECT count(*) FROM k) AS distinct_sql, substring(key, 1, 120) AS most_common_sql, round(times * 1.0e0 / n, 3) AS most_common_frac,
  CASE WHEN times * 1.0e0 / n > 0.3 THEN times ELSE 0 END AS answer_collapse, CAST(times * 1.0e0 / n > 0.3 OR nf > 0 AS INTEGER) AS suspicious FROM a, top"""

QUERIES = {
    "parse_completion": (parse_completion, f"{PARSED_SQL} SELECT doc_id, sql_text FROM p"),
    "format_score": (format_score, f"{COMPLETIONS_SQL.rstrip(', ')} SELECT doc_id, {_FMT} AS score FROM c"),
    "guard_flags": (guard_flags, GUARD_SQL),
    "norm_text": (norm_text, f"SELECT doc_id, md5({NORM.format(x='text')}) AS norm FROM documents"),
    "token_count": (token_count, f"SELECT doc_id, len({_tokens_sql('text')}) AS n_tokens FROM documents"),
    "canon_key": (canon_key, CANON_SQL),
    "dedup_first": (dedup_first, r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"),
    "leak_rule1": (leak_rule1, f"WITH {LINES_SQL} SELECT DISTINCT a.id, b.item FROM (SELECT id, {NORM.format(x='text')} AS n FROM lines) a JOIN (SELECT item, {NORM.format(x='text')} AS n FROM items) b ON a.n = b.n"),
    "leak_rule2": (leak_rule2, RULE2_SQL),
    "leak_containment": (leak_containment, CONTAIN_SQL),
    "leak_audit": (leak_audit, AUDIT_SQL),
    "contamination_audit": (contamination_audit, RULES_SQL),
    "perturb_paraphrase": (_apply(tx.paraphrase), _paraphrase_sql()),
    "perturb_rename": (_apply(tx.rename), _rename_sql()),
    "perturb_distractor": (_apply(tx.distractor, "c_custkey"), DISTRACT_SQL),
    "perturb_typo": (perturb_typo, TYPO_SQL),
    "key_nouns": (key_nouns, rf"SELECT c_custkey, array_to_string((list_filter(regexp_split_to_array(q, '\s+'), lambda w: length(w) > 4))[1:3], ' ') AS nouns FROM (SELECT c_custkey, {QUESTION} AS q FROM customer)"),
    "balanced_take": (balanced_take, f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ORDER}) AS turn FROM documents) ORDER BY turn, source LIMIT 100"),
    "allocate": (allocate, _allocate_sql()),
    "stratified_split": (stratified_split, f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {ORDER}) <= round_even(count(*) OVER (PARTITION BY lang) * 0.2e0, 0) THEN 'val' ELSE 'train' END AS split FROM documents"),
    "split_disjoint": (split_disjoint, "SELECT CAST(0 AS BIGINT) AS n_shared"),
    "split_report": (split_report, "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_families, count(DISTINCT text) AS n_questions FROM documents GROUP BY ROLLUP (lang)"),
    "review_sample": (review_sample, f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ORDER}) AS r FROM documents) WHERE r = 1"),
    "hack_flags": (hack_flags, f"{PARSED_SQL} SELECT count(*) AS n, {_FLAGS} FROM (SELECT lower(sql_text) AS low FROM p)"),
    "mode_share": (mode_share, MODE_SQL),
    "composite_reward": (composite_reward, COMPOSITE_SQL),
    "proxy_reward": (proxy_reward, PROXY_SQL),
}
