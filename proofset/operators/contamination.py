"""Contamination of candidates by held-out texts, and de-duplication by key.

Token-set rules meet candidates and held-out items on the items' rarest tokens (an
equi-join), of which a similar text cannot miss all; the pairs found are confirmed on
full token sets. Common tokens make no pairs unless an item has no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.functions import text as tx
from proofset.sources.records import cut

#: Held-out tokens are broadcast up to this measured size.
BROADCAST_BYTES = 32 << 20


def token_sets(df: DataFrame, id_col: str, text_col: str, name: str = "tokens") -> DataFrame:
    return df.select(F.col(id_col), tx.content_tokens(F.col(text_col)).alias(name))


def exact_questions(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rule 1: pairs (id, item) with equal normalised text."""
    a = candidates.select("id", tx.norm_question(F.col("text")).alias("norm"))
    b = held_out.select("item", tx.norm_question(F.col("text")).alias("norm"))
    return a.join(b, "norm").select("id", "item").distinct()


def rarest_tokens(held_out: DataFrame, least: float) -> DataFrame:
    """(item, token, b): of each held-out item's tokens ``b`` as many of the rarest as a text with the
    share ``least`` of them cannot miss all of: n - ceil(least * n) + 1 of n.

    Rare means in few held-out items, so that a candidate's token leads to few of them, and
    among those long, as longer words are rarer in texts. The order never changes results.
    """
    sets = token_sets(held_out, "item", "text", "b").select("item", "b", F.explode_outer("b").alias("token"))
    times = sets.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    ranked = sets.join(times, "token").groupBy("item", "b").agg(F.sort_array(F.collect_list(F.struct("times", (-F.length("token")).alias("short"), "token"))).alias("ranked"))
    needed = F.ceil(F.size("b") * F.lit(least) - 1e-9)  # rounding may only lengthen the list
    first = F.slice("ranked", F.lit(1), F.greatest(F.size("b") - needed + 1, F.lit(1)).cast("int"))
    return ranked.select("item", "b", F.explode(first).alias("x")).select("item", "x.token", "b")


def token_overlaps(candidates: DataFrame, held_out: DataFrame, least: float, alike: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, item, shared, n_id, n_item) of the pairs that share ``least`` of the item's tokens, at least.

    A Jaccard similarity of ``least`` asks for that too, and, ``alike``, for sizes that allow
    it, which are looked at before the tokens. Where the rarest tokens and their
    items' sets fit ``broadcast_bytes``, candidates meet them in one pass and only what is
    confirmed is shuffled; beyond that, pairs are found first and then get their sets.
    """
    rare = cut(rarest_tokens(held_out, least))
    # An outer explode, as the filter of an inner one is pushed down and takes the tokens twice.
    sets = token_sets(candidates, "id", "text", "a")
    found = sets.select("id", "a", F.explode_outer("a").alias("token"))
    size = rare.agg(F.sum(F.octet_length(F.array_join("b", " ")) + 24 * F.size("b") + F.octet_length("token") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        met = found.join(F.broadcast(rare), "token")
    else:
        pairs = found.select("id", "token").join(rare.select("item", "token"), "token").select("id", "item").distinct()
        met = sets.join(pairs, "id").join(rare.select("item", "b").dropDuplicates(["item"]), "item")
    if alike:
        met = met.filter(F.size("b") >= least * F.size("a"))
    sizes = met.select("id", "item", F.size(F.array_intersect("a", "b")).alias("shared"), F.size("a").alias("n_id"), F.size("b").alias("n_item"))
    return sizes.filter(F.col("shared") / F.col("n_item") >= least).distinct()


def near_questions(candidates: DataFrame, held_out: DataFrame, least: float = 0.85) -> DataFrame:
    """Rule 2: (id, item, jaccard) from ``least`` up."""
    similarity = F.col("shared") / (F.col("n_id") + F.col("n_item") - F.col("shared"))
    found = token_overlaps(candidates, held_out, least, alike=True).withColumn("jaccard", similarity).filter(F.col("jaccard") >= least).select("id", "item", "jaccard")
    return found.union(_tokenless(candidates, held_out))


def _tokenless(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """(id, item, 1.0) of texts without content tokens, whose set equals that of an item without.

    All such items are one class, for which the first one stands, so there is a pair for
    each text and not for each text and item.
    """
    first = token_sets(held_out, "item", "text").filter(F.size("tokens") == 0).agg(F.min("item").alias("item")).filter("item IS NOT NULL")
    texts = token_sets(candidates, "id", "text").filter(F.size("tokens") == 0).select("id", F.lit(0).alias("__empty")).distinct()
    # One row.
    return texts.join(F.broadcast(first.withColumn("__empty", F.lit(0))), "__empty").select("id", "item", F.lit(1.0).alias("jaccard"))


def containment(candidates: DataFrame, held_out: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, item, contained): the share of an item's tokens that a candidate has."""
    contained = F.col("shared") / F.col("n_item")
    return token_overlaps(candidates, held_out, least).withColumn("contained", contained).select("id", "item", "contained")


def canonical_matches(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rule 3: (id, item) with equal canonical statements."""
    a = candidates.select("id", tx.canonical_sql(F.col("gold")).alias("canon"))
    b = held_out.select("item", tx.canonical_sql(F.col("gold")).alias("canon"))
    return a.join(b, "canon").select("id", "item").distinct()


def signature_matches(candidates: DataFrame, held_out: DataFrame, least: float = 0.5) -> DataFrame:
    """Rule 4: the first item (by position) with the candidate's signature, and whether its
    question is similar enough to reject. Only that first item counts."""
    firsts = held_out.groupBy("signature").agg(F.min_by(F.struct("item", "position", "text"), "position").alias("first")).select("signature", "first.*")
    met = candidates.select("id", "signature", tx.content_tokens(F.col("text")).alias("a")).join(firsts.withColumn("b", tx.content_tokens(F.col("text"))), "signature")
    return met.select("id", "item", (tx.jaccard(F.col("a"), F.col("b")) >= least).alias("rejected"))


def audit(candidates: DataFrame, held_out: DataFrame) -> DataFrame:
    """``candidates`` (id, text, gold, signature) with ``rule``: the first of rules 1 to 4 that
    rejects, or ``signature_only`` (counted, not rejected), or null."""
    flags = [
        (exact_questions(candidates, held_out), "rule1_exact_question"),
        (near_questions(candidates, held_out), "rule2_near_duplicate_question"),
        (canonical_matches(candidates, held_out), "rule3_canonical_sql"),
    ]
    out = candidates
    for i, (found, name) in enumerate(flags):
        out = out.join(found.select("id", F.lit(name).alias(f"__r{i}")).distinct(), "id", "left")
    fourth = signature_matches(candidates, held_out)
    name = F.when(F.col("rejected"), F.lit("rule4_result_and_question")).otherwise(F.lit("signature_only"))
    out = out.join(fourth.select("id", name.alias("__r3")), "id", "left")
    return out.withColumn("rule", F.coalesce(*(F.col(f"__r{i}") for i in range(4)))).drop(*(f"__r{i}" for i in range(4)))


def first_by_key(df: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row by position of each key; keys are grouped by their digest, not by their text.

    Rows that share the key and its smallest position stay together, as nothing orders
    them; a null position comes after all others.
    """
    marked = df.withColumn("__key", F.unhex(F.sha2(key, 256)))
    firsts = marked.groupBy("__key").agg(F.min(position).alias("__first"))
    met = marked.alias("a").join(firsts.alias("b"), F.col("a.__key").eqNullSafe(F.col("b.__key")) & F.col(f"a.{position}").eqNullSafe(F.col("b.__first")), "left_semi")
    return met.drop("__key")
