"""Running sums and maxima over a whole table's order, without one task that sorts it.

Rows are dealt to ranges of the order by sampled boundaries and written once with their
range. Each range's total is one row, of which there are as many as shuffle partitions;
what the ranges before it add is told from these, and the rest is a window within a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofset.sources.records import cut


def running(df: DataFrame, order: list[str], total: str | None = None, best: str | None = None) -> DataFrame:
    """``df`` with ``__upto``, the sum of ``total`` up to each row, itself included, and
    ``__before``, the greatest ``best`` before it (null where there is none).

    Rows should differ in ``order``; those that don't count in an order of no meaning.
    """
    sums = {"__upto": total} if total else {}
    tops = {"__before": best} if best else {}
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"{n}_in") for n, c in sums.items()), *(F.max(c).alias(f"{n}_in") for n, c in tops.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)).alias(f"{n}_base") for n in sums] + [F.max(f"{n}_in").over(earlier).alias(f"{n}_base") for n in tops]
    met = ranged.join(parts.select("__part", *bases), "__part")
    own = Window.partitionBy("__part").orderBy(*order)
    rows = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    made = {n: F.sum(c).over(rows) + F.col(f"{n}_base") for n, c in sums.items()} | {n: F.greatest(F.max(c).over(past), F.col(f"{n}_base")) for n, c in tops.items()}
    return met.withColumns(made).drop("__part", *(f"{n}_base" for n in made))
