from __future__ import annotations

from proofset.sources import tables
from proofset.streaming import events as ev


def test_stream_equals_batch(spark, small, tmp_path):
    rows = tables.load(spark, small, "events").withColumn("ts", tables.F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    query = (
        ev.windowed(ev.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("windows").exceptAll(ev.windowed(rows)).isEmpty() and spark.table("windows").count() == ev.windowed(rows).count()


def test_sessions(spark, small):
    rows = tables.load(spark, small, "events")
    assert ev.sessions(rows).groupBy().sum("n").first()[0] == rows.count()
