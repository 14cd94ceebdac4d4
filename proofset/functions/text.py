"""Text expressions: statements, questions, canonical forms, perturbations, prompts.

All of them are built-in column expressions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: verbs, keywords, word lists, rewrites and formats --------
WRITE_VERBS = ("insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "vacuum", "reindex", "truncate")
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "pragma", "vacuum", "reindex", "begin", "commit")
STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "be", "been", "with", "that",
    "which", "who", "what", "how", "many", "much", "return", "show", "list", "give", "please", "each", "every", "all", "their",
    "them", "it", "its", "as", "by", "from", "do", "does", "did", "me", "my", "you", "your", "there", "have", "has", "had",
)
OVERLAP_STOPWORDS = (
    "return", "which", "what", "show", "list", "give", "many", "each", "every", "there", "their", "with", "that", "from",
    "only", "across", "please", "total", "number",
)
PARAPHRASES = (
    (r"^List the names of all ", "Give me every "),
    (r"^List the names of ", "Give me the names of "),
    (r"^Show all ", "Return all "),
    (r"^Show the ", "Return the "),
    (r"^Show ", "Return "),
    (r"^List ", "Return "),
    (r"^How many ", "What is the count of "),
    (r"^What is the ", "Tell me the "),
    (r"^Which ", "What "),
    (r"^Find ", "Locate "),
    (r"^Return only the ", "Give just the "),
    (r"\bReturn the ", "Give the "),
    (r"\bproducts\b", "items"),
    (r"\bcustomers\b", "clients"),
)
RENAMES = (
    (r"\bcustomers?\b", "buyers"),
    (r"\bproducts?\b", "SKUs"),
    (r"\borders?\b", "purchases"),
    (r"\bcategory\b", "product group"),
    (r"\bsegment\b", "tier"),
)
DISTRACTORS = (
    " Ignore any rows that do not exist.",
    " Note that the database is small.",
    " Please be careful with the join.",
    " This is for a quarterly report.",
    " The answer should be computed from the tables above.",
)
NEIGHBOUR_KEYS = {"a": "s", "e": "r", "i": "o", "o": "p", "u": "y", "n": "m", "t": "y", "s": "d", "r": "t", "l": "k", "c": "v", "m": "n"}
FENCE = r"(?is)```(?:sql)?\s*(.*?)```"
TOOL_CALL = r"(?s)<tool>\s*(\{.*?\})\s*</tool>"
PROSE_LIMIT = 40
# -----------------------------------------------------------------------------

_BLANK = r"[\x20\x09-\x0D\x1C-\x1F]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def extract_statement(text: Column) -> Column:
    """The first statement of a completion: inside the first fence, or of the whole text."""
    whole = _strip(F.coalesce(text, F.lit("")))
    inner = F.when(whole.rlike(FENCE), _strip(F.regexp_extract(whole, FENCE, 1))).otherwise(whole)
    inner = F.regexp_replace(inner, rf"(?i)^{_BLANK}*sql{_BLANK}*:{_BLANK}*", "")
    cut = F.when(F.contains(inner, F.lit(";")), F.concat(F.substring_index(inner, ";", 1), F.lit(";"))).otherwise(inner)
    return _strip(cut)


def format_score(text: Column) -> Column:
    """1 for exactly one fence and little prose, 0.5 with more prose, else 0."""
    whole = F.coalesce(text, F.lit(""))
    fences = F.size(F.regexp_extract_all(whole, F.lit(FENCE), F.lit(0)))
    outside = F.length(_strip(F.regexp_replace(whole, FENCE, "")))
    return F.when(fences != 1, 0.0).when(outside > PROSE_LIMIT, 0.5).otherwise(1.0)


def _head(sql: Column) -> Column:
    return F.lower(F.regexp_replace(_strip(sql), r"^\(+", ""))


def looks_like_select(sql: Column) -> Column:
    return _head(sql).rlike("^(?:select|with)")


def is_write(sql: Column) -> Column:
    """Starts with a write verb (as a prefix), or has a later part that does."""
    verbs = f"^(?:{'|'.join(WRITE_VERBS)})"
    parts = F.filter(F.transform(F.split(sql, ";"), lambda p: F.lower(_strip(p))), lambda p: p != "")
    later = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike(verbs))
    return _head(sql).rlike(verbs) | F.coalesce(later, F.lit(False))


def is_read_only(sql: Column) -> Column:
    """One select or with statement in which no forbidden keyword stands between spaces."""
    body = F.substring_index(sql, "--", 1)
    semicolons = F.length(body) - F.length(F.replace(body, F.lit(";"), F.lit("")))
    single = (semicolons == 0) | ((semicolons == 1) & F.endswith(F.regexp_replace(body, rf"{_BLANK}+$", ""), F.lit(";")))
    keywords = F.concat(F.lit(" "), _head(sql), F.lit(" ")).rlike(f" (?:{'|'.join(FORBIDDEN)}) ")
    return looks_like_select(sql) & single & ~keywords


def norm_question(q: Column) -> Column:
    """Lower case, no quotes, punctuation as spaces, single spaces."""
    bare = F.regexp_replace(F.lower(q), "[\"'`]", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}_]+", " "))


def content_tokens(q: Column) -> Column:
    """Distinct words of the normalised question that are neither stopwords nor digits."""
    stop = F.array(*map(F.lit, ["", *STOPWORDS]))
    words = F.array_except(F.split(norm_question(q), " "), stop)
    return F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def canonical_sql(sql: Column) -> Column:
    """Upper-case text without aliases, qualifiers and surplus spaces."""
    out = F.regexp_replace(F.regexp_replace(_strip(sql), ";+$", ""), r"\s+", " ")
    for pattern, to in (
        (r"(?i)\bAS\s+\w+", ""),
        (r"(?i)\b([a-z]{1,3})\.", ""),
        (r"(?i)\b(JOIN\s+\w+)\s+[a-z]{1,3}\b", "$1"),
        (r"(?i)\b(FROM\s+\w+)\s+[a-z]{1,3}\b", "$1"),
        (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return F.upper(F.trim(out))


def dedup_key(sql: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))


def overlap(sql: Column, question: Column) -> Column:
    """Share of the question's longer words that are identifiers of the statement."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z_]{4,}"), F.lit(0)))
    used = words(sql)
    asked = F.array_except(words(question), F.array(*map(F.lit, OVERLAP_STOPWORDS)))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(used, asked)) / F.greatest(F.size(asked), F.lit(1)))


def fill(template: Column, slots: Column) -> Column:
    """Replace each ``{key}`` of the template by the map's value."""
    return F.aggregate(F.map_entries(slots), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def paraphrase(q: Column) -> Column:
    """The rewrites in order, each at its first place only; then a capital first letter."""
    out = q
    for pattern, to in PARAPHRASES:
        out = F.regexp_replace(out, f"(?s)^(.*?){pattern.lstrip('^')}" if not pattern.startswith("^") else pattern, to if pattern.startswith("^") else f"$1{to}")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))


def rename(q: Column) -> Column:
    out = q
    for pattern, to in RENAMES:
        out = F.regexp_replace(out, f"(?i){pattern}", to)
    return out


def distractor(q: Column, key: Column) -> Column:
    """The question with a sentence that a hash of ``key`` picks."""
    pick = F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("int") % len(DISTRACTORS)
    return F.concat(F.regexp_replace(q, r"\s+$", ""), F.element_at(F.array(*map(F.lit, DISTRACTORS)), pick + 1))


def typo(q: Column, key: Column) -> Column:
    """Slips in up to two longer words in lower case and without quotes.

    A hash of ``key`` and the word's place chooses words, letters and the kind of slip:
    a neighbouring key, or two letters exchanged.
    """
    words = F.split(q, " ")
    drawn = lambda i, salt: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(salt)))), 1, 6), 16, 10).cast("int")
    draw = lambda i, n, salt: drawn(i, salt) % n
    fit = lambda w: (F.length(F.regexp_replace(w, r"^[.,?']+|[.,?']+$", "")) > 4) & ~F.contains(w, F.lit("'")) & w.rlike("^[a-z]")
    places = F.filter(F.transform(words, lambda w, i: F.when(fit(w), i)), lambda i: i.isNotNull())
    chosen = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(drawn(i, 1).alias("rank"), i.alias("i")))), 1, 2)
    hit = F.transform(chosen, lambda s: s["i"])
    near = F.create_map(*(F.lit(x) for pair in NEIGHBOUR_KEYS.items() for x in pair))

    def slip(w: Column, i: Column) -> Column:
        at = (draw(i, F.length(w) - 2, 2) + 2).cast("int")
        letter, rest = F.substring(w, at, F.lit(1)), F.substring(w, at + 1, F.length(w))
        swapped = F.concat(F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, F.lit(1)), letter, F.substring(w, at + 2, F.length(w)))
        other = near[F.lower(letter)]
        return F.when(other.isNotNull() & (draw(i, F.lit(2), 3) == 0), F.concat(F.substring(w, F.lit(1), at - 1), other, rest)).otherwise(swapped)

    return F.array_join(F.transform(words, lambda w, i: F.when(F.array_contains(hit, i), slip(w, i)).otherwise(w)), " ")


def key_nouns(q: Column) -> Column:
    """The first three words of more than four letters, joined."""
    return F.array_join(F.slice(F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 4), 1, 3), " ")


def tool_call(text: Column) -> Column:
    """struct(name, args) of the first tool call; the name of bad JSON is ``__bad_json__``."""
    raw = F.regexp_extract(F.coalesce(text, F.lit("")), TOOL_CALL, 1)
    parsed = F.from_json(raw, "name string, args map<string,string>")
    bad = F.struct(F.lit("__bad_json__").alias("name"), F.lit(None).cast("map<string,string>").alias("args"))
    return F.when(raw == "", None).when(parsed["name"].isNull(), bad).otherwise(parsed)


TOOL_HELP = '<tool>{"name": "list_tables|describe_table|sample_rows|run_query", "args": {"table": "...", "sql": "..."}}</tool>'
SYSTEM = "Answer with one read-only SQL query in a ```sql block and nothing else."


def prompt(question: Column, schema: str, extra: Column | None = None) -> Column:
    """Chat messages for a question: system, then schema, extra block and question."""
    blocks = [F.lit(f"Tables:\n{schema}")] + ([F.nullif(extra, F.lit(""))] if extra is not None else []) + [F.concat(F.lit("Question: "), question)]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM)), message("user", F.concat_ws("\n\n", *blocks)))


def tool_prompt(question: Column, schema: str | None, max_turns: int) -> Column:
    """Chat messages of an episode with tools; without a schema the policy has to look it up."""
    known = [F.lit(f"Tables:\n{schema}")] if schema else []
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = f"{SYSTEM} Before that you may call tools, one to a reply, {max_turns} replies in all: {TOOL_HELP}"
    return F.array(message("system", F.lit(system)), message("user", F.concat_ws("\n\n", *known, F.concat(F.lit("Question: "), question))))


def repair_prompt(question: Column, schema: str, sql: Column, error: Column) -> Column:
    """Chat messages that show a failed statement and its error."""
    shown = F.concat_ws("\n", F.lit("The last query failed."), F.concat(F.lit("Query: "), sql), F.concat(F.lit("Error: "), error))
    return prompt(question, schema, shown)


def render_steps(steps: Column, limit: int = 600) -> Column:
    """An array of (role, content) as text blocks, each body cut at ``limit``."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s["role"], F.lit("]\n"), F.substring(s["content"], 1, limit))), "\n\n")
