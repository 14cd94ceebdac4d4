"""Personal data spans in texts, in DataFrame expressions only.

Regular expressions propose spans. Positions come from the pieces between matches
and the matches themselves, whose lengths add up; all positions are code points.
Running sums and maxima are folded in runs of ``RUN`` values whose totals are folded
in turn, and parts of a text are cut from its chunks of ``CHUNK`` code points, so the
work grows with the text and its spans, not with their product.
Validators confirm: octet ranges of addresses, Luhn for cards, digit counts for
phones, mod-97 for IBANs. Words nearby ("card", "phone", "iban" ...) raise a span's
score. Base kinds (email, ip, card, phone) are always reported; the added kinds,
``iban`` and ``ssn``, only from ``THRESHOLD`` up.

Each expression is written so that it can't go on matching from the middle of a
run that its start has already failed on, and repeats possessively: time stays
linear and no repetition recurses, however long the text. A text is only searched
for a kind if it has a character that the kind needs.

Defined results
    null or empty text   no spans
    ties                 spans that start together are ordered by kind as listed
    overlaps             kinds are independent; each may report the same place
    repeated rows        each is searched by itself
    empty table          empty result
    extra columns        ``redact`` keeps them, whatever their names; ``find`` does not
                         read them
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import documents, fresh, quoted

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: What each kind looks like. The guard in front keeps a match from starting
#: inside a run, except where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap sign that the kind can occur at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score before context, what context adds, how far it reaches (code points).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
BOOST, REACH, THRESHOLD = 0.3, 40, 0.5
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": "card|credit|visa|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": r"\bssn\b|social security|tax id",
}

#: Values of a running fold, and code points of a text, that are taken together.
RUN, CHUNK = 64, 512

_SPANS = "array<struct<start:int,kind:int,end:int,score:double>>"

# Expressions below are built of column functions. As SQL text they were 21 kB, and the
# states that Spark's parser keeps for such nested text took 45 to 50 MB of the driver for good.


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def _numbered(n: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of 0, 1, ... n - 1 as an array."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: body(i))


def _running(values: Column, fold: Callable[[Column, Column], Column], level: int = 2) -> Column:
    """The folds, from 0, of the first value, the first two values and so on.

    A value's fold starts from that of the runs before its own, which is found the same way.
    """
    folded = lambda part, base: F.aggregate(part, base, lambda a, x: fold(a, x))
    if not level:
        return _let(values, lambda v: _numbered(F.size(v), lambda i: folded(F.slice(v, F.lit(1), i + 1), F.lit(0))))

    def of(v: Column) -> Column:
        totals = _numbered(F.ceil(F.size(v) / RUN), lambda b: folded(F.slice(v, b * RUN + 1, F.lit(RUN)), F.lit(0)))
        base = lambda before, i: F.when(i >= RUN, F.get(before, _div(i, RUN) - 1)).otherwise(F.lit(0))
        each = lambda before, i: folded(F.slice(v, i - i % RUN + 1, i % RUN + 1), base(before, i))
        return _let(_running(totals, fold, level - 1), lambda before: _numbered(F.size(v), lambda i: each(before, i)))

    return _let(values, of)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0) of the text in ``chunks``."""
    first = _div(start, CHUNK).cast("int")
    many = F.greatest(F.least(_div(start + length, CHUNK).cast("int") + 1, F.size(chunks)) - first, F.lit(0))
    return F.substring(F.array_join(F.slice(chunks, first + 1, many), ""), start - first * CHUNK + 1, length)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _flat(match: Column) -> Column:
    return F.replace(match, F.lit(" "), F.lit(""))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(match: Column) -> Column:
    doubled = lambda c: c * 2 - F.when(c > 4, 9).otherwise(0)
    digits = F.transform(_characters(F.reverse(_digits(match))), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(doubled(c.cast("int"))))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    turned = F.concat(F.substring(_flat(match), 5, 64), F.substring(_flat(match), 1, 4))
    digit = lambda c: c.rlike("[0-9]")
    value = lambda c: F.when(digit(c), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_characters(turned), F.lit(0), lambda a, c: (a * F.when(digit(c), 10).otherwise(100) + value(c)) % 97) == 1


def _within(match: Column, least: int, most: int, confirmed: Column) -> Column:
    return F.when(F.length(match).between(least, most), confirmed).otherwise(F.lit(False))


#: Whether a match is confirmed.
_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.|$)){4}$"),
    "card": lambda m: _within(_digits(m), 14, 19, _luhn(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: _within(_flat(m), 15, 34, _mod97(m)),
    "ssn": lambda m: F.lit(True),
}
#: A cheap sign that the kind can occur at all, where it is no single character.
_POSSIBLE = {"card": r"[0-9](?:[\x20-]?[0-9]){13}", "iban": "[A-Z]{2}[0-9]{2}"}


def _proposed(kind: str, text: Column) -> Column:
    """Confirmed matches of a kind as structs of start, kind's number, end and score."""
    pattern, none = PATTERNS[kind], F.array().cast(_SPANS)

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
        span = lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))
        return F.zip_with(found, _running(steps, lambda a, x: a + x), span)

    def score(chunks: Column, s: Column) -> Column:
        near = _part(chunks, F.greatest(s["start"] - REACH, F.lit(0)), s["end"] - s["start"] + 2 * REACH)
        return F.least(F.lit(PRIOR[kind]) + F.when(near.rlike(f"(?i){CONTEXT[kind]}"), BOOST).otherwise(0.0), F.lit(1.0))

    def spans(kept: Column, chunks: Column) -> Column:
        span = lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), score(chunks, s).alias("score"))
        return F.transform(kept, span).cast(_SPANS)

    scored = lambda kept: F.when(F.size(kept) > 0, _let(_chunks(text), lambda chunks: spans(kept, chunks))).otherwise(none)
    confirmed = lambda found: F.filter(placed(found), lambda s: _VALID[kind](s["match"]))
    out = _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: _let(confirmed(found), scored))
    if kind not in BASE_KINDS:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(_POSSIBLE[kind]), out).otherwise(none)


def _spans(text: Column) -> Column:
    """All spans in order."""
    return F.sort_array(F.concat(*(_proposed(k, F.coalesce(text, F.lit(""))) for k in KINDS)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_<base kind>, base_sha256, spans, scores."""
    found = docs.select(quoted(id_col).alias("id"), _spans(quoted(text_col).cast("string")).alias("found"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(
        "id",
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def _cleaned(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the first one's kind."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def runs(found: Column, reach: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(found, i)["start"] >= F.get(reach, F.greatest(i - 1, F.lit(0))))
        begins = F.filter(_numbered(F.size(found), lambda i: F.when(first(i), i)), lambda i: i.isNotNull())
        last = lambda firsts, k: F.coalesce(F.get(firsts, k + 1), F.size(found)) - 1
        run = lambda firsts, i, k: F.struct(F.get(found, i)["start"].alias("start"), F.get(found, i)["kind"].alias("kind"), F.get(reach, last(firsts, k)).alias("end"))
        return _let(begins, lambda firsts: F.transform(firsts, lambda i, k: run(firsts, i, k)))

    def rebuilt(runs: Column, chunks: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(runs, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0)
        piece = lambda s, i: F.concat(_part(chunks, before(i), s["start"] - before(i)), F.element_at(names, s["kind"] + 1))
        last = F.element_at(runs, -1)["end"]
        return F.concat(F.array_join(F.transform(runs, piece), ""), _part(chunks, last, F.length(text) - last))

    def replaced(found: Column) -> Column:
        reach = _running(F.transform(found, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        return _let(reach, lambda reach: _let(runs(found, reach), lambda runs: _let(_chunks(text), lambda chunks: rebuilt(runs, chunks))))

    return _let(spans, lambda found: F.when(F.size(found) > 0, replaced(found)).otherwise(text))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first. ``count_col``, if given and
    there, gets the new text's length in code points. Null texts stay null.
    """
    found = fresh(docs.columns, "found_spans")
    text = quoted(text_col).cast("string")
    out = docs.withColumn(found, _spans(text)).withColumn(text_col, _cleaned(text, F.col(found))).drop(found)
    if count_col and count_col in docs.columns:
        out = out.withColumn(count_col, F.length(quoted(text_col)).cast("long"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), split AS (
  SELECT doc_id, body, 0 AS kind, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS found,
         string_split_regex(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM t
  UNION ALL
  SELECT doc_id, body, 1, regexp_extract_all(body, '[0-9]+(?:\.[0-9]+){3}'), string_split_regex(body, '[0-9]+(?:\.[0-9]+){3}') FROM t
  UNION ALL
  SELECT doc_id, body, 2, regexp_extract_all(body, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(body, '[0-9](?:[\x20-]?[0-9])+') FROM t
  UNION ALL
  SELECT doc_id, body, 3, regexp_extract_all(body, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(body, '\+[0-9][\x20().0-9-]+[0-9]') FROM t
  UNION ALL  -- starts of IBANs, with the character before
  SELECT doc_id, body, 4, regexp_extract_all(body, '(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}'), string_split_regex(body, '(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}') FROM t
  UNION ALL  -- whole runs of digits and hyphens
  SELECT doc_id, body, 5, regexp_extract_all(body, '[0-9-]+'), string_split_regex(body, '[0-9-]+') FROM t
), each AS (
  SELECT doc_id, body, kind, unnest(found) AS match, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS i FROM split
), placed AS (
  SELECT doc_id, body, kind, match, regexp_replace(match, '[^0-9]', '', 'g') AS digits,
         CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop
  FROM each
), started AS (
  SELECT doc_id, body, stop - 4 AS start, regexp_extract(body[stop - 3:stop + 61], '^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}') AS match
  FROM placed WHERE kind = 4
), whole AS (
  SELECT doc_id, body, match, start, start + length(match) AS stop
  FROM started WHERE match <> '' AND NOT regexp_matches(body[start + length(match) + 1:start + length(match) + 1], '[A-Za-z0-9]')
), iban AS (  -- leftmost, non-overlapping
  SELECT doc_id, min(start) AS start, arg_min(stop, start) AS stop FROM whole GROUP BY doc_id
  UNION ALL
  SELECT w.doc_id, min(w.start), arg_min(w.stop, w.start) FROM iban JOIN whole AS w ON w.doc_id = iban.doc_id AND w.start >= iban.stop GROUP BY w.doc_id
), turned AS (
  SELECT w.*, replace(w.match, ' ', '') AS flat FROM whole AS w JOIN iban USING (doc_id, start)
), numbered AS (
  SELECT *, array_to_string(list_transform(string_split(flat[5:] || flat[:4], ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS number
  FROM turned WHERE length(flat) BETWEEN 15 AND 34
), confirmed AS (
  SELECT doc_id, body, kind, stop - length(match) AS start, stop FROM placed
  WHERE CASE kind
    WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(match, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''),
      lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN c > '4' THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 10 AND 15
    WHEN 5 THEN regexp_full_match(match, '[0-9]{3}-[0-9]{2}-[0-9]{4}')
    ELSE false END
  UNION ALL
  SELECT doc_id, body, 4, start, stop FROM numbered
  WHERE list_reduce(list_transform(string_split(number, ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1
), near AS (
  SELECT *, substring(body, greatest(start - 39, 1), stop - start + 80) AS around FROM confirmed
), scored AS (
  SELECT doc_id, kind, start, stop, ['email', 'ip', 'card', 'phone', 'iban', 'ssn'][kind + 1] AS name, CASE kind
    WHEN 0 THEN CASE WHEN regexp_matches(around, '(?i)mail|contact|write to') THEN 1.0 ELSE 0.9 END
    WHEN 1 THEN CASE WHEN regexp_matches(around, '(?i)\bip\b|address|host|server') THEN 0.9 ELSE 0.6 END
    WHEN 2 THEN CASE WHEN regexp_matches(around, '(?i)card|credit|visa|payment') THEN 1.0 ELSE 0.8 END
    WHEN 3 THEN CASE WHEN regexp_matches(around, '(?i)phone|call|tel|mobile|fax') THEN 0.9 ELSE 0.6 END
    WHEN 4 THEN CASE WHEN regexp_matches(around, '(?i)iban|account|bank') THEN 1.0 ELSE 0.9 END
    ELSE CASE WHEN regexp_matches(around, '(?i)\bssn\b|social security|tax id') THEN 0.7 ELSE 0.4 END END AS score
  FROM near
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(concat_ws(':', name, start, stop), ',' ORDER BY start, kind) FILTER (kind < 4) AS base,
         string_agg(concat_ws(':', name, start, stop), ',' ORDER BY start, kind) AS spans,
         string_agg(format('{:.2f}', CAST(score AS DOUBLE)), ',' ORDER BY start, kind) AS scores
  FROM scored WHERE kind < 4 OR score >= 0.5 GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN told ON told.doc_id = t.doc_id
"""
