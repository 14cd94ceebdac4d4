"""Reproducible orders and balanced allocation.

Order comes from md5(seed:key), then the key: the same whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofset.sources.records import cut

CAP_MULTIPLE, CAP_LEAST = 2.5, 4


def hash_order(key: str, seed: int = 1234) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def balanced_take(rows: DataFrame, k: int, family: str, key: str, taken: dict[str, int] | None = None, cap: int | None = None, seed: int = 1234) -> DataFrame:
    """``k`` rows, each time one of the family taken least so far (ties by name).

    A row's turn is its rank in the family plus what was taken of it before, so the
    greedy order is a sort by (turn, family). Of a family only the first ``k`` rows can
    be taken, so each task keeps no more of it before the shuffle that ranks them.
    """
    taken = taken or {}
    rank = F.row_number().over(Window.partitionBy(family).orderBy(*hash_order(key, seed)))
    before = F.coalesce(F.create_map(*(F.lit(x) for kv in taken.items() for x in kv))[F.col(family)], F.lit(0)) if taken else F.lit(0)
    first = rows.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    turned = first.withColumn("turn", F.col("__rank") + before).drop("__rank")
    if cap is not None:
        turned = turned.filter(F.col("turn") <= cap)
    return turned.orderBy("turn", family).limit(k)


def allocate(rows: DataFrame, n: int, mix: list[tuple[str, float]], family: str, level: str, key: str, seed: int = 1234) -> DataFrame:
    """``n`` rows by level shares as far as they go, the rest from what is left.

    Families share one running count and one cap over all levels. The counts that the
    driver keeps are bounded by the number of families.
    """
    families = rows.select(family).distinct().count() or 1
    cap = max(int(n / families * CAP_MULTIPLE), CAP_LEAST)
    taken: dict[str, int] = {}
    parts: list[DataFrame] = []

    def take(pool: DataFrame, k: int) -> int:
        part = cut(balanced_take(pool, k, family, key, taken, cap, seed))
        got = part.groupBy(family).count().collect()
        for r in got:
            taken[r[family]] = taken.get(r[family], 0) + r["count"]
        parts.append(part)
        return sum(r["count"] for r in got)

    total = sum(take(rows.filter(F.col(level) == name), round(n * share)) for name, share in mix)
    if total < n:
        chosen = parts[0].select(key)
        for p in parts[1:]:
            chosen = chosen.unionByName(p.select(key))
        take(rows.join(chosen, key, "left_anti"), n - total)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("turn").limit(n) if total > n else out.drop("turn")


def stratified_split(rows: DataFrame, share: float, level: str, key: str, seed: int = 1234) -> DataFrame:
    """``rows`` with ``split``: the first round(share * n) of each level are ``val``, others ``train``.

    Places are counted per (level, hash bucket) with bases, so a level is no single task.
    """
    bucket = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 2)
    bucketed = rows.withColumn("__bucket", bucket)
    sizes = bucketed.groupBy(level, "__bucket").agg(F.count(F.lit(1)).alias("__n"))  # at most 256 rows a level
    base = F.sum("__n").over(Window.partitionBy(level).orderBy("__bucket")) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy(level))
    sizes = sizes.select(level, "__bucket", base.alias("__base"), total.alias("__total"))
    rank = F.row_number().over(Window.partitionBy(level, "__bucket").orderBy(*hash_order(key, seed)))
    placed = bucketed.withColumn("__rank", rank).join(sizes, [level, "__bucket"])
    val = F.col("__base") + F.col("__rank") <= F.bround(F.col("__total") * F.lit(share), 0)
    return placed.withColumn("split", F.when(val, "val").otherwise("train")).drop("__bucket", "__n", "__base", "__total", "__rank")


def overlap_count(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """One row: how many keys two splits share."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))


def split_report(rows: DataFrame, level: str, family: str, question: str) -> DataFrame:
    """Rows, families and distinct questions by level, and in all (level null)."""
    return rows.rollup(level).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(family).alias("n_families"), F.countDistinct(question).alias("n_questions")
    )


def one_per_family(rows: DataFrame, family: str, key: str, seed: int = 1234) -> DataFrame:
    """A review sample: the first row of each family in hash order."""
    first = F.min(F.struct(*(c.alias(n) for c, n in zip(hash_order(key, seed), ("h", "k"), strict=True)))).alias("first")
    picked = rows.groupBy(family).agg(first).select(F.col("first.k").alias(key))
    return rows.join(picked, key, "left_semi")
