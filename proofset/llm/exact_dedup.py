"""Exact de-duplication by a stateful stream with disk-backed keyed state.

Each row becomes (digest of the normalised text, id, locator, length). A
streaming aggregation keyed by digest holds, in RocksDB and without expiry, the
smallest id, the locator of that row and the number of rows. Partial aggregation
ahead of the state's exchange leaves one row per digest and task, so a text that
a third of all rows share costs its partition no more than any other. The state
is read back as a table from the stream's checkpoint in the shared folder.

Digest hits (digests with more than one row) are then checked on full bytes: the
rows of those digests, told by a bitmap of bounded size, are reduced to the least
and the greatest text of each digest, again with partial aggregation; both must be
the same and as long as the content that the locator names. If one digest turns out to hold several texts, each text gets its own group.

Dropping is by row: by id and text together (``row_keys``), so an id that stands on
several texts, or none at all, loses no row that stays. Rows that surely stay are
told by a bitmap and are not shuffled.

Defined results
    null text        counts as the empty text; all empty texts are one group
    null id          ranks after every id; such a row stays only if its group has no id
    repeated ids     an id on several texts: each row is decided by its own text
    repeated rows    rows with the same id and text share one decision, and each counts
                     in ``group_size``; ``drop_exact_copies`` leaves one row of each group,
                     also where its smallest id stands on several rows, or no row has an id
    empty table      empty result
    extra columns    ``drop_exact_copies`` keeps them; else they are not read, so
                     their names cannot clash
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofset.llm.common import bit, bitmap, documents, quoted, row_keys, scratch_path, stage, without_rows

#: White space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"

#: Upper bound of digest rows' bytes that one micro-batch takes.
BATCH_BYTES = 256 << 30

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # One pass and out: a store closes with its task instead of holding disk until the end.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_state(spark: SparkSession, source: str, schema: StructType, checkpoint: str) -> DataFrame:
    """Run the stream over every digest row under ``source``; return its state.

    Running it again with the same checkpoint takes only files that are new.
    """
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(source)
    seen = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    with _settings(spark, STATE_SETTINGS):
        query = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key").getField(state.schema["key"].dataType.fieldNames()[0]).alias("digest"),
        F.col("value").getField(value[0]).alias("first"),
        F.col("value").getField(value[1]).alias("n"),
    )


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, part, and the row's keys k1, k2.

    Digest and part together tell the group.
    """
    spark = docs.sparkSession
    given = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    k1, k2 = row_keys(F.col("id"), F.col("text"))
    rows = given.select("id", normalised(F.col("text")).alias("body"), k1.alias("k1"), k2.alias("k2"))
    keyed = rows.select(
        F.unhex(F.sha2("body", 256)).alias("digest"),
        "id",
        F.struct(F.input_file_name().alias("file"), F.octet_length("body").alias("bytes")).alias("locator"),
        "k1",
        "k2",
    )
    source, checkpoint = scratch_path(spark, "dedup-digests"), scratch_path(spark, "dedup-stream")
    keyed.write.parquet(source)
    digests = spark.read.schema(keyed.schema).parquet(source)
    if digests.isEmpty():
        return digests.select("id", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.lit(0).cast("long").alias("part"), "k1", "k2")
    state = stage(stream_state(spark, source, keyed.schema, checkpoint), "dedup-state")
    if _collided(rows, state):
        return _by_text(rows)
    groups = state.select("digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"))
    return digests.select("id", "digest", "k1", "k2").join(groups, "digest").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", F.lit(0).cast("long").alias("part"), "k1", "k2"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, id_col, text_col).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _collided(rows: DataFrame, state: DataFrame) -> bool:
    """Whether a digest that was hit stands for more than one text.

    The rows of hit digests are told by a bitmap, so that texts which nobody repeats
    stay where they are.
    """
    hits = state.filter("n > 1").select("digest", F.col("first.locator.bytes").alias("bytes"))
    suspects = _of_hits(rows.withColumn("digest", F.unhex(F.sha2("body", 256))), hits.select("digest"))
    texts = suspects.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"), F.count(F.lit(1)).alias("n"))
    differ = texts.join(hits, "digest").filter((F.col("least") != F.col("most")) | (F.octet_length("least") != F.col("bytes")))
    return not differ.isEmpty()


def _of_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose digest is in ``hits``, and a few others."""
    k1, k2 = F.xxhash64("digest"), F.xxhash64(F.lit(5), "digest")
    marks, words = bitmap(hits.select(k1.alias("k1"), k2.alias("k2")))
    found = rows.withColumns({"word": F.pmod(k1, F.lit(words)), "bit": bit(k2)}).join(F.broadcast(marks), "word")
    return found.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def _by_text(rows: DataFrame) -> DataFrame:
    """The decision on full texts alone, for the case that two texts share a digest."""
    groups = rows.groupBy("body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "body").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("part"), *(c for c in ("k1", "k2") if c in rows.columns)
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, one with the smallest id; columns unchanged."""
    rows = _decided(docs, id_col, text_col).filter("group_size > 1")
    # Narrow rows of groups only; a group of copies is one row per task ahead of the shuffle.
    keyed = stage(rows.groupBy("digest", "part", "k1", "k2").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "dedup-keys")
    # Only rows with the smallest id are joined, which are few in any group.
    least = keyed.filter("kept").groupBy("digest", "part").agg(F.min(F.struct("k1", "k2")).alias("least"))
    told = keyed.filter("kept").join(least, ["digest", "part"]).select("k1", "k2", "n", (F.struct("k1", "k2") == F.col("least")).alias("stays"))
    told = told.union(keyed.filter("NOT kept").select("k1", "k2", "n", F.lit(False).alias("stays")))
    fates = stage(told.filter("NOT stays OR n > 1").select("k1", "k2", "stays"), "dedup-fates")
    return without_rows(docs, fates, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
