"""Audit of how filters interact over all orders in which they could be applied.

1. Each text gets a mask of the filters that it fails. Failing by text alone is told in
   the row; the duplicates' filter takes the smallest id of each text's digest, with
   partial aggregation, and rows join that on digest and id together, so a text that a
   third of all rows have moves no more than others.
2. Documents are counted per mask cell: (part, mask), with sums of good and toxic ones.
   From here on the size is bounded by parts times masks.
3. Long form: each cell is unpivoted to a row for each step of each order. A running
   bit-or window over the steps tells whether an earlier step removed the cell;
   conditional sums give the steps' counts, and a window over (part, filter) their total
   over all orders.

Rows of each part are all orders times all steps, zeros included, as each cell has a row
for every step.

Defined results
    null text        counts as the empty text; null part as the empty string
    empty text       no words: fails only the filter on few words, and that on duplicates
                     if a smaller id has an empty text
    very long text   processed whole
    null id          ranks after every id; among rows without id and with the same text
                     none is smaller, so if no row of theirs has an id, none fails
    ties             rows that share the smallest id of a text do not fail
    repeated rows    each counts; repeated labels of an id count once, as good or toxic if
                     one of them says so
    empty table      empty result
    extra columns    are not read, so their names cannot clash

Texts are told apart by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.llm.common import documents, quoted, stage, table

SPACES = r"[\x20\x09-\x0D]+"
#: Of the filters; the last is that on duplicates.
LETTERS = "ABCDE"
#: A fails under so many words.
FEW_WORDS = 100
#: B fails under so many distinct words of 100.
DISTINCT_PERCENT = 80
#: C fails over so many capitals of 100 characters.
CAPITAL_PERCENT = 10
#: D fails on any of these characters.
SYMBOLS = "[#$%&*|]"


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_failures(text: Column) -> dict[str, Column]:
    """What a text fails by itself."""
    words = F.array_remove(F.split(text, SPACES), "")
    return {
        "A": F.size(words) < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per input row: id, part, mask (bit i: the filter with the i-th letter)."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    given = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = F.lit(0)
    for letter, fails in text_failures(F.col("text")).items():
        mask = mask + F.when(fails, _bit(letter)).otherwise(0)
    rows = stage(given.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask")), "audit-rows")
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(True).alias("smallest"))
    met = rows.alias("r").join(least.alias("l"), (F.col("r.digest") == F.col("l.digest")) & F.col("r.id").eqNullSafe(F.col("l.id")), "left")
    copy = F.when(F.col("l.smallest").isNull(), _bit("E")).otherwise(0)
    return met.select("r.id", "r.part", (F.col("r.mask") + copy).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents, and of these good and toxic ones."""
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sums = (F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic"))
    return masked.join(said, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The metrics of each part, order and step of ``counted`` (part, mask, n, good, toxic)."""
    orders = F.explode(F.split(F.lit(",".join(map("".join, permutations(letters)))), ","))
    long = counted.select("*", orders.alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter")).withColumn("step", F.col("place") + 1)
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.col("letter")) - 1)
    long = long.withColumn("bit", bit).withColumn("failing", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("before", F.coalesce(F.bit_or("failing").over(earlier), F.lit(0)))
    fails, out = F.col("failing") != 0, F.col("before") != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~out).alias("kept"),
        total(fails & ~out).alias("removed"),
        total(fails & out).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~out, "good").alias("good_lost"),
        total(fails & ~out, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return steps.withColumn("shapley", shapley).drop("letter")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(cells(failures(documents(spark, sf_dir)), table(spark, sf_dir, "labels")), "audit-cells")
    return audit(counted)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 1 ELSE 0 END AS e,
    CASE WHEN labels.quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN labels.toxic = 1 THEN 1 ELSE 0 END AS toxic
  FROM d LEFT JOIN labels USING (doc_id)
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order
  FROM l AS v, l AS w, l AS x, l AS y, l AS z
  WHERE len(list_distinct([v.letter, w.letter, x.letter, y.letter, z.letter])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS done FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), k AS (
  SELECT part, concat(CASE WHEN a = 1 THEN 'A' ELSE '' END, CASE WHEN b = 1 THEN 'B' ELSE '' END, CASE WHEN c = 1 THEN 'C' ELSE '' END,
    CASE WHEN d = 1 THEN 'D' ELSE '' END, CASE WHEN e = 1 THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL
), r AS (
  SELECT part, filter_order, step, letter, failed, n, good, toxic, contains(failed, letter) AS fails,
    len(list_filter(string_split(done, ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone
  FROM k, s
), t AS (
  SELECT part, filter_order, step, letter,
    CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM t
"""
