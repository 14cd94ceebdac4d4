"""Interval estimates and paired tests, as columns and for numbers on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.functions.ordered import running

#: Two-sided normal quantiles of the usual levels.
Z_TABLE = {0.10: 1.6448536, 0.05: 1.9599640, 0.01: 2.5758293}


def z_value(alpha: float) -> float:
    return Z_TABLE.get(alpha) or NormalDist().inv_cdf(1 - alpha / 2)


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval; (0, 1) without trials."""
    z = z_value(alpha)
    m = F.greatest(n, F.lit(1)).cast("double")
    p = k / m
    centre = (p + z * z / (m * 2.0)) / (z * z / m + 1.0)
    half = F.sqrt(p * (-p + 1.0) / m + z * z / (m * m * 4.0)) * z / (z * z / m + 1.0)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def wilson_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    if not n:
        return 0.0, 1.0
    z, p = z_value(alpha), k / n
    scale = 1 + z * z / n
    middle, reach = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + (z / (2 * n)) ** 2)
    return max(0.0, (middle - reach) / scale), min(1.0, (middle + reach) / scale)


def report(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """``0.750  [0.505, 0.898]  (12/16)``"""
    low, high = wilson(k, n, alpha)
    share = F.when(n == 0, 0.0).otherwise(k / F.greatest(n, F.lit(1)))
    return F.format_string("%.3f  [%.3f, %.3f]  (%d/%d)", share, low, high, k.cast("long"), n.cast("long"))


def successes(result: Any) -> tuple[int, int]:
    """(k, n) from a pair, a result with records or accuracy and n, or a list."""
    match result:
        case (k, n) if isinstance(result, tuple):
            return int(k), int(n)
        case {"records": records}:
            return successes(list(records))
        case {"accuracy": accuracy, "n": n}:
            return int(round(accuracy * n)), int(n)
        case list():
            return sum(bool(r["correct"] if isinstance(r, dict) else r) for r in result), len(result)
    raise TypeError(f"no successes in {type(result).__name__}")


def sign_test(a_only: int, b_only: int) -> float:
    """Exact two-sided probability of so uneven a split of disagreements.

    Terms are taken from the largest one down, by their ratios, until they no longer count:
    some square root of n of them, whatever n is.
    """
    n, i = a_only + b_only, min(a_only, b_only)
    term, tail = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)), 0.0
    while i >= 0 and term > tail * 1e-17:
        tail += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * tail)


def mcnemar_chi(a_only: int, b_only: int) -> float:
    """The approximate form, kept as exp(-x/2): the survival function of two degrees of freedom."""
    n = a_only + b_only
    return math.exp(-((abs(b_only - a_only) - 1) ** 2) / n / 2) if n else 1.0


def discordant(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row over paired 0/1 columns: a_only, b_only, n_discordant, ties, n, delta."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    count = lambda c: F.count(F.when(c, 1))
    return pairs.agg(
        count(x > y).alias("a_only"),
        count(y > x).alias("b_only"),
        count(x != y).alias("n_discordant"),
        count(x == y).alias("ties"),
        F.count(F.lit(1)).alias("n"),
        (F.sum(y - x) / F.count(F.lit(1))).alias("delta"),
    )


def mcnemar(pairs: DataFrame, a: str, b: str, exact: bool = True) -> dict[str, Any]:
    row = discordant(pairs, a, b).first()
    p = (sign_test if exact else mcnemar_chi)(row.a_only, row.b_only)
    note = "no disagreement" if not row.n_discordant else "too few disagreements" if row.n_discordant <= 3 else ""
    return {"a_only": row.a_only, "b_only": row.b_only, "n_discordant": row.n_discordant, "p_two_sided": p, "note": note}


def bootstrap_means(items: DataFrame, value: str, resamples: int, seed: int = 0, salt: str = "boot") -> DataFrame:
    """(resample, mean) over resampled items.

    The values' counts, one row per distinct value, are what resampling needs: each
    resample draws n items by hashed positions into their running counts. The paired
    0/1 differences this serves have three values, so nothing grows with the items but
    the draws themselves.
    """
    counts = sorted((r["v"], r["n"]) for r in items.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    spark = items.sparkSession
    if not n:
        return spark.createDataFrame([], "resample long, mean double")
    draws = spark.range(resamples * n).select((F.col("id") % resamples).alias("resample"), F.expr(f"id div {resamples}").alias("draw"))
    key = F.md5(F.concat_ws(":", F.lit(f"{salt}{seed}"), "resample", "draw"))
    at = F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % n
    seen = np.cumsum([c for _, c in counts]).tolist()
    drawn = F.when(F.col("at") < seen[0], F.lit(float(counts[0][0])))
    for (v, _), upto in zip(counts[1:], seen[1:], strict=True):
        drawn = drawn.when(F.col("at") < upto, F.lit(float(v)))
    return draws.select("resample", at.alias("at")).select("resample", drawn.alias("x")).groupBy("resample").agg((F.sum("x") / n).alias("mean"))


#: Distinct values up to which resamples are drawn as counts.
COUNTED_VALUES = 4096


def bootstrap_counts(items: DataFrame, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, mean) over resampled items, drawn as counts of the distinct values.

    A resample of n items holds its values in multinomial counts, which are drawn value by
    value as conditional binomials, so the work is resamples times distinct values whatever
    n is. Each resample has a generator of its own, keyed by seed and number, so a task that
    runs again draws the same. Nulls are not items; more than ``COUNTED_VALUES`` distinct
    values go to ``bootstrap_means``.
    """
    known = items.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["v"], r["n"]) for r in known.limit(COUNTED_VALUES + 1).collect())
    if len(counts) > COUNTED_VALUES:
        return bootstrap_means(items.filter(F.col(value).isNotNull()), value, resamples, seed)
    spark = items.sparkSession
    if not counts:
        return spark.createDataFrame([], "resample long, mean double")
    values, sizes = (np.array(x) for x in zip(*counts, strict=True))
    n = int(sizes.sum())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = []
            for resample in batch.column(0).to_pylist():
                drawn = np.random.Generator(np.random.Philox(key=[seed % (1 << 64), resample])).multinomial(n, sizes / n)
                means.append(float(drawn @ values) / n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], names=["resample", "mean"])

    return spark.range(resamples).select(F.col("id").alias("resample")).mapInArrow(draw, "resample long, mean double")


def paired_bootstrap(pairs: DataFrame, a: str, b: str, resamples: int = 10_000, seed: int = 0, alpha: float = 0.05, by_items: bool = False) -> dict[str, Any]:
    """Observed difference, its interval by sorted position, p-value, wins and ties.

    Resamples are drawn as counts, or ``by_items`` as one hashed draw for each item of each.
    """
    row = discordant(pairs, a, b).first()
    if not row.n:
        return {"delta": 0.0, "ci": (0.0, 0.0), "p_two_sided": 1.0, "n": 0}
    diffs = pairs.select((F.col(b).cast("int") - F.col(a).cast("int")).alias("d"))
    means = sorted(r["mean"] for r in (bootstrap_means if by_items else bootstrap_counts)(diffs, "d", resamples, seed).collect())
    low, high = means[int(alpha / 2 * resamples)], means[min(int((1 - alpha / 2) * resamples), resamples - 1)]
    p = sum(abs(m - row.delta) >= abs(row.delta) for m in means) / resamples
    return {"delta": row.delta, "ci": (low, high), "p_two_sided": min(1.0, p), "n": row.n, "wins_a": row.a_only, "wins_b": row.b_only, "ties": row.ties}


def compare(pairs: DataFrame, a: str, b: str) -> str:
    """Both accuracies with intervals, their difference and the test, as text."""
    boot, test = paired_bootstrap(pairs, a, b), mcnemar(pairs, a, b)
    totals = pairs.agg(F.sum(F.col(a).cast("int")).alias("a"), F.sum(F.col(b).cast("int")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    out = []
    for name, k in ((a, totals.a or 0), (b, totals.b or 0)):
        low, high = wilson_interval(k, totals.n)
        out.append(f"{name}: {k / max(totals.n, 1):.3f}  [{low:.3f}, {high:.3f}]  ({k}/{totals.n})")
    out.append(f"difference {boot['delta']:+.3f}  [{boot['ci'][0]:+.3f}, {boot['ci'][1]:+.3f}]  p={boot['p_two_sided']:.3f}")
    out.append(f"disagreements {test['n_discordant']}, sign test p={test['p_two_sided']:.3f} {test['note']}".rstrip())
    return "\n".join(out)


def seed_summary(runs: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), range and number of runs."""
    return runs.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def nearest_rank(df: DataFrame, value: str, key: str | None, shares: dict[str, float]) -> DataFrame:
    """Per key, the value at sorted position min(floor(n * share), n - 1), without interpolation.

    Distinct values are counted first and ranked by running counts over ranges of (key,
    value), so neither a key's rows nor its distinct values are gathered in a task.
    """
    keys = [key] if key else []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ran = running(counted, [*keys, "__v"], total="__c")
    sizes = ran.groupBy(*(F.col(k).alias("__k") for k in keys)).agg(F.sum("__c").alias("__n"), F.min(F.col("__upto") - F.col("__c")).alias("__first"))
    if key:
        met = ran.join(sizes, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    else:
        met = ran.withColumn("__one", F.lit(1)).join(sizes.withColumn("__one", F.lit(1)), "__one")  # one row
    upto = F.col("__upto") - F.col("__first")
    pick = lambda q: F.min(F.when(upto > F.least(F.floor(F.col("__n") * F.lit(q)), F.col("__n") - 1), F.col("__v")))
    return met.groupBy(*keys).agg(F.max("__n").alias("n"), *(pick(q).alias(name) for name, q in shares.items()))
