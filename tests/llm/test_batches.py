from __future__ import annotations

from pyspark.sql import functions as F

from proofset.llm import common


def largest(spark, rows, letters):
    def sizes(batches):
        for b in batches:
            yield b.select([]).from_pydict({"n": [b.num_rows], "mb": [b.nbytes / 1e6]})

    docs = spark.range(0, rows, numPartitions=1).select("id", F.repeat(F.lit("x"), letters).alias("text"))
    return [(r.n, r.mb) for r in docs.mapInArrow(sizes, "n long, mb double").collect()]


def test_batches_of_texts_are_cut_by_bytes(spark):
    common.small_batches(spark)
    found = largest(spark, 6000, 4000)
    assert sum(n for n, _ in found) == 6000 and max(mb for _, mb in found) < 4
    long = largest(spark, 5, 5_000_000)
    assert [n for n, _ in long] == [1] * 5


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "9m")
        common.small_batches(spark)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
