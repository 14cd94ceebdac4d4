"""A corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
and reads again as the next stage's documents. All but the last return the columns
of documents. Batches are kept small for all of them, as an executor's memory holds what
every stage has left there, and each stage may run by itself. The pipeline is not expressible in SQL (a fitted model, MinHash and a
tokenizer take part), so it is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofset.llm import exact_dedup, near_dedup, packing, pii, quality
from proofset.llm.common import documents, ship, small_batches, stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    ship(spark)
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of equal texts."""
    small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the kind's name; ``n_chars`` follows the text."""
    small_batches(spark)
    return pii.redact(docs, count_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    small_batches(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
