"""Sharding by sampled splitters, in DataFrame operations only.

1. Each row is reduced to (key, id, size, crc), where the key is a 64-bit hash of
   the text: equal texts are neighbours. This table is written once.
2. Keys are drawn with a chance in proportion to size; quantiles of the sample
   are the splitters of up to ``MAX_RANGES`` ranges. Sample and splitters have a
   fixed bound whatever the input, so collecting the one and broadcasting the
   other is safe.
3. Rows are dealt to ranges by an equi-join on the key's leading bits, after
   which at most a few splitters are compared.
4. Bytes and rows of each range are counted. A range with more than twice its
   share (a text that many rows have) is subdivided by a hash of the id, into as
   many parts as its bytes ask for.
5. Consecutive parts are put into shards by their middle on the scale of total
   bytes; the place in the shard is the part's base plus the rank in the part.

The law is ``bytes``: shards differ by about one part, 1/512 of a shard, or one
document where those are larger. Equal texts share a shard unless their range
had to be subdivided.

Defined results
    null text        size 1, crc of the empty text; grouped with empty texts
    null id          sorts before other ids within its part
    repeated rows    each row gets a place of its own
    ties             equal keys are ordered by id
    empty table      empty result
    extra columns    are not read, so their names cannot clash
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.llm.common import documents, stage

SHARDS = 8
#: Ranges per table at most, and sampled keys per range (on average).
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 8
#: Leading key bits on which rows meet the splitters.
LOOKUP_BITS = 10


def _splitters(rows: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantile boundaries of keys drawn by size."""
    rate = ranges * SAMPLES_PER_RANGE / total
    draw = F.pmod(F.xxhash64(F.col("id"), F.col("key"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    # A row of more bytes than one draw stands for counts several times.
    times = F.floor(F.col("size") * rate + draw).cast("long")
    drawn = rows.select("key", times.alias("times")).filter("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    sample = sorted((r.key, r.times) for r in drawn.collect())
    step = sum(t for _, t in sample) / ranges
    out, seen, due = [], 0.0, step
    for key, times in sample:
        seen += times
        if seen >= due and len(out) < ranges - 1:
            out.append(key)
            due = (int(seen / step) + 1) * step
    return out


def _lookup(spark: SparkSession, splitters: list[int]) -> DataFrame:
    """For each value of the leading bits: how many splitters lie before it, and those inside."""
    width = 64 - LOOKUP_BITS
    low = -(1 << 63)
    rows = []
    for lead in range(1 << LOOKUP_BITS):
        a = bisect_left(splitters, low + (lead << width))
        b = bisect_left(splitters, low + ((lead + 1) << width))
        rows.append((lead, a, splitters[a:b]))
    return spark.createDataFrame(rows, "lead int, before int, inside array<long>")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(body).alias("key"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    result = ["id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*result)
    ranges = max(shards, min(MAX_RANGES, n))
    lookup = _lookup(spark, _splitters(rows, ranges, total))
    lead = F.shiftright(F.col("key"), 64 - LOOKUP_BITS).cast("int") + F.lit(1 << (LOOKUP_BITS - 1))
    dealt = rows.withColumn("lead", lead).join(F.broadcast(lookup), "lead")
    dealt = dealt.withColumn("range", F.col("before") + F.size(F.filter("inside", lambda s: s < F.col("key"))))
    dealt = dealt.select("id", "key", "size", "text_crc32", "range")

    # Counted per range; what is overfull is cut by a hash of the id.
    share = total / ranges
    counted = dealt.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = F.when(F.col("bytes") > 2 * share, F.ceil(F.col("bytes") / share)).otherwise(1).cast("int")
    counted = stage(counted.select("range", parts.alias("parts")), "shard-ranges")
    cut = stage(
        dealt.join(F.broadcast(counted), "range").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).drop("parts"),
        "shard-parts",
    )

    # A few thousand parts, whatever the input: one task orders them.
    sums = cut.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("range", "part")
    placed = sums.withColumn("middle", F.sum("bytes").over(order) - F.col("bytes") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(F.col("middle") * shards / total), F.lit(shards - 1)).cast("int"))
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n")
    placed = stage(placed.select("range", "part", "shard", base.alias("base")), "shard-places")
    rank = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "id"))
    ranked = cut.withColumn("rank", rank.cast("long") - 1)
    return ranked.join(F.broadcast(placed), ["range", "part"]).withColumn("slot", F.col("base") + F.col("rank")).select(*result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
