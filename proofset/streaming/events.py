"""Structured streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.sources import tables


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New files under a directory of events, as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped by the engine."""
    ts = F.col("ts").cast("timestamp")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withColumn("ts", ts).withWatermark("ts", late)
    grouped = rows.groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("value")).select(
        F.col("w.start").alias("start"), "event_type", "n", "value"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = windowed(tables.load(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "value")


def session_counts(spark: SparkSession, d: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user by gaps between events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = tables.load(spark, d, "events").withColumn("before", F.lag("ts").over(order))
    gap = F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr(f"INTERVAL {gap_minutes} MINUTES"))
    return rows.groupBy("user_id").agg(F.count(F.when(gap, 1)).alias("sessions"), F.count(F.lit(1)).alias("events"))


def property_sums(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return tables.load(spark, d, "events").groupBy("event_type").agg(F.sum(k).cast("long").alias("k_sum"), F.max(k).alias("k_max"))
