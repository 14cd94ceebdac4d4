"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

1. Words (lower case, between white space) become 64-bit hashes, runs of five words
   one shingle hash each; a text of fewer words is one shingle. A shingle's leading
   bits choose one of ``BINS`` bins, and each bin keeps its smallest hash. Hashes are
   sorted together with one sentinel per bin, the largest value that the bin can
   have, so the value after each sentinel is the next bin's minimum, or its sentinel if that
   bin is empty.
2. Empty bins are filled by optimal densification: each has a random sequence of bins
   of its own, and borrows from the first that is filled. The sequence is ``TRIES``
   random bins, and then all bins in a random order.
3. What a bin holds is hashed with the bin's number, and the low ``BITS`` bits of that
   are stored, packed into 64-bit words. Two different values so agree in a bin with
   probability 2^-BITS, whichever bins borrowed them, which ``likeness`` corrects:
   (agreeing share - 2^-BITS) / (1 - 2^-BITS), not below 0.

``edits`` joins each document with the head of the next one. Order is settled on
narrow rows (id and 128-bit key), range-partitioned; each document learns how much of
it the one before needs, and only those heads are sent on: a quarter of all text.
Fingerprints travel with the texts and are computed once.

Defined results
    null text        counts as the empty text
    no words         no fingerprint: an empty array (query: an empty string), whose
                     likeness is 1 to another such, 0 to any other
    very long text   processed whole
    null id          after every id; among equal ids order is by a hash of the text
    repeated rows    rows with the same id and text are one place in the order; each
                     has a result row, and the next document is the next place's
    one document     is its own next
    empty table      empty result
    extra columns    ``with_fingerprint`` keeps them; else they are not read, so
                     their names cannot clash
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.llm.common import documents, fresh, quoted, row_keys, stage

WORDS = 5
BINS, BITS = 256, 4
#: Random bins that an empty bin tries before all bins in its random order.
TRIES = 16
#: Besides the space.
BLANKS = "\t\n\x0b\x0c\r"

PER_WORD = 64 // BITS
#: Bits of a shingle hash below those that choose the bin.
_REST = 64 - (BINS.bit_length() - 1)
_LOW = (1 << BITS) - 1
#: The lowest bit of each packed value.
_ONES = sum(1 << (i * BITS) for i in range(PER_WORD))


def _shift(name: str, x: Column, bits: int) -> Column:
    return F.call_function(name, x, F.lit(bits))


def _sentinels() -> Column:
    """The largest value of each bin, which is odd."""
    bins = F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1))
    return F.transform(bins, lambda b: _shift("shiftleft", b.cast("long"), _REST).bitwiseOR(F.lit((1 << _REST) - 1)))


def _words(text: Column) -> Column:
    # Single spaces split without a regular expression.
    body = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for blank in BLANKS:
        body = F.replace(body, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(body, " "), "")


def _shingles(h: Column) -> Column:
    """Hashes of all runs of ``WORDS`` word hashes, even ones."""
    runs = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WORDS))).bitwiseAND(F.lit(-2)))
    return F.slice(runs, 1, F.greatest(F.size(h) - (WORDS - 1), F.least(F.size(h), F.lit(1))))


def _donors(attempt: int) -> Column:
    """For each bin, a random bin; one literal, which is folded, as plans of thousands are slow."""
    draw = random.Random(attempt)
    return F.split(F.lit(",".join(str(draw.randrange(BINS)) for _ in range(BINS))), ",").cast("array<int>")


def _filled(bins: Column, real: Column, value: Column, b: Column) -> Column:
    """``value``, or what the bin ``b`` borrows; ``real`` holds the filled bins' values."""
    tries = (F.get(bins, F.get(_donors(t), b)) for t in range(TRIES))
    rank = F.array_min(F.transform(real, lambda x, i: F.xxhash64(b, _shift("shiftright", x, _REST)).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("long"))))
    return F.coalesce(value, *tries, F.get(real, rank.bitwiseAND(F.lit(BINS - 1)).cast("int")))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the packed fingerprint of ``text`` as column ``name``, an array of long.

    Each step is a column of its own, as later ones read it more than once.
    """
    h, s, d, r, c = (fresh((*df.columns, name), f"fp_{x}") for x in ("hashes", "sorted", "bins", "real", "codes"))
    made = df.withColumn(h, F.transform(_words(text), lambda x: F.xxhash64(x)))
    made = made.withColumn(s, F.sort_array(F.concat(_shingles(F.col(h)), _sentinels())))
    firsts = F.filter(s, lambda x, i: F.coalesce(F.get(F.col(s), i - 1).bitwiseAND(F.lit(1)) == 1, F.lit(True)))
    made = made.withColumn(d, F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(1)) == 0, x)))
    made = made.withColumn(r, F.array_compact(d))
    codes = F.transform(d, lambda x, b: F.xxhash64(_filled(F.col(d), F.col(r), x, b), b).bitwiseAND(F.lit(_LOW)))
    made = made.withColumn(c, F.when(F.size(r) > 0, codes).otherwise(F.array().cast("array<bigint>")))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)),
        lambda k: F.aggregate(F.slice(F.col(c), k * PER_WORD + 1, F.lit(PER_WORD)), F.lit(0).cast("long"), lambda acc, x: _shift("shiftleft", acc, BITS).bitwiseOR(x)),
    )
    made = made.withColumn(name, F.when(F.size(c) > 0, packed).otherwise(F.array().cast("array<bigint>")))
    return made.drop(h, s, d, r, c)


def as_text(packed: Column) -> Column:
    """A packed fingerprint as hexadecimal digits."""
    return F.concat(*(F.coalesce(F.lpad(F.hex(F.get(packed, i)), 16, "0"), F.lit("")) for i in range(BINS // PER_WORD)))


def likeness(a: Column, b: Column) -> Column:
    """The similarity of shingle sets that two packed fingerprints stand for, 0 to 1."""
    differing = None
    for i in range(BINS // PER_WORD):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(_shift("shiftright", x, k))
        n = F.bit_count(any_bit.bitwiseAND(F.lit(_ONES)))
        differing = n if differing is None else differing + n
    chance = 2.0**-BITS
    share = 1.0 - differing / float(BINS)
    same = F.greatest(F.lit(0.0), (share - chance) / (1.0 - chance))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, same).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def _order(rows: DataFrame) -> DataFrame:
    """Of (id, k1, k2, n), one row for each place in the order: k1, k2, id, n, and of the
    place before t1, t2 (its key) and ``need``, how many characters of this text it takes."""
    places = rows.groupBy("id", "k1", "k2").agg(F.max("n").alias("n"))
    ranged = stage(places.repartitionByRange(F.col("id").asc_nulls_last(), "k1", "k2").withColumn("part", F.spark_partition_id()), "fingerprint-order")
    here = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "n")
    # One row for each range, of which there are as many as shuffle partitions.
    last = ranged.groupBy("part").agg(F.max(here).alias("last"))
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("last").over(line), F.last("last").over(whole))
    last = stage(last.select("part", before.alias("before")), "fingerprint-ranges")
    own = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "k1", "k2")
    known = ranged.withColumn("previous", F.lag(here).over(own)).join(last, "part")
    known = known.withColumn("previous", F.coalesce("previous", "before"))
    return stage(
        known.select("k1", "k2", "id", "n", F.col("previous.k1").alias("t1"), F.col("previous.k2").alias("t2"), F.floor(F.col("previous.n") / 4).alias("need")),
        "fingerprint-places",
    )


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited (the text with its last quarter replaced
    by the next document's beginning), fingerprint, edited_fingerprint, next_fingerprint."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    k1, k2 = row_keys(quoted(id_col), quoted(text_col))
    rows = docs.select(quoted(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    order = _order(rows.select("id", "k1", "k2", F.char_length("text").cast("long").alias("n")))
    printed = with_fingerprint(rows.select("k1", "k2", "text"), F.col("text"), "fingerprint")
    heads = printed.join(order.select("k1", "k2", "t1", "t2", "need").hint("merge"), ["k1", "k2"])
    heads = heads.select(
        F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.struct(F.col("text").substr(F.lit(1), F.col("need").cast("int")).alias("head"), "fingerprint").alias("next")
    ).groupBy("k1", "k2").agg(F.first("next").alias("next"))
    placed = printed.join(order.select("k1", "k2", "id", "n").hint("merge"), ["k1", "k2"]).join(heads.hint("merge"), ["k1", "k2"])
    kept = F.col("text").substr(F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    changed = placed.select("id", F.col("n").alias("n_chars"), "fingerprint", F.concat(kept, "next.head").alias("edited"), F.col("next.fingerprint").alias("next_fingerprint"))
    return with_fingerprint(changed, F.col("edited"), "edited_fingerprint").select("id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
