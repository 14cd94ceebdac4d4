"""Connected components of an edge table, by rounds of joins.

Labels start at the smallest neighbour and fall by two steps a round: to the
smallest label among neighbours, then to the label of the label. Each round is
written to the shared folder. Hubs are no problem: minima are combined before the
shuffle, and the joins are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Repeated edges and loops do no harm. No edges: an empty table.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        pulled = stage(pulled, "cc-pulled")
        up = pulled.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = stage(
            pulled.join(up, "label").select("node", "old", F.least("label", "up").alias("label")),
            "cc-labels",
        )
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
