"""Shared plumbing of the training-data operators.

Scratch tables go to the folder in ``spark.checkpoint.dir`` (shared by driver
and executors). Where that setting is absent, a local master, as in tests, gets a
temporary folder of this machine; on a cluster that is an error.

A row is told from others by ``row_keys``: 128 bits of its id and text. Decisions
about rows (which copies go) are taken by these keys, never by ids alone, as an id
may stand on several texts or be null.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised per-document kernels take at a time.
KERNEL_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='proofset-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, unless their path has it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    name = Path(tempfile.mkdtemp(prefix="proofset-code-"), "proofset")
    context.addPyFile(shutil.make_archive(str(name), "zip", root, "proofset"))
    _shipped.add(context.applicationId)


#: Rows hold whole texts: batches are cut by bytes, and by fewer rows than Spark's own setting gives.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def small_batches(spark: SparkSession) -> None:
    """Use ``BATCH_SETTINGS`` for the rest of the session, where it has no settings of its own."""
    for k, v in BATCH_SETTINGS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


#: Upper bound of a bitmap of row keys: so many 64-bit words.
BITMAP_WORDS = 1 << 20


def fresh(names: Iterable[str], wanted: str) -> str:
    """A column name like ``wanted`` that is not among ``names``, upper or lower case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that rows with the same id and text share; null texts count as empty ones."""
    name, body = id_col.cast("string"), F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(name, body), F.xxhash64(F.lit(7), body, name)


def bit(k2: Column) -> Column:
    """The key's bit in its word of a bitmap."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", k2, F.lit(58)).cast("int"))


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(word, bits) over the (k1, k2) of ``keys`` and the number of words, which is bounded.

    Keys that are not in it are surely not among ``keys``; a full bitmap lets more
    rows pass and loses none.
    """
    words = max(1 << 10, min(BITMAP_WORDS, 4 * keys.count()))
    marked = keys.select(F.pmod("k1", F.lit(words)).alias("word"), bit(F.col("k2")).alias("bit"))
    return stage(marked.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")), "bitmap"), words


def sifted(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows that may be among ``keys``, rows that surely aren't, names of the former's keys).

    Only the former need a shuffle to tell. Both have the columns of ``docs``, the
    former its two keys besides.
    """
    k1, k2, word, bits = (fresh(docs.columns, n) for n in ("row_k1", "row_k2", "row_word", "row_bits"))
    marks, words = bitmap(keys)
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(quoted(id_col), quoted(text_col)), strict=True)))
    keyed = keyed.withColumn(word, F.pmod(k1, F.lit(words)))
    seen = keyed.join(F.broadcast(marks.toDF(word, bits)), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(F.col(k2))) != 0, F.lit(False))
    columns = [quoted(c) for c in docs.columns]
    return seen.filter(hit).select(*columns, k1, k2), seen.filter(~hit).select(*columns), [k1, k2]


def one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``docs`` for each value of ``keys``, without these: the least by a digest of all columns.

    Partial aggregation leaves one row per key and task ahead of the shuffle.
    """
    columns = [quoted(c) for c in docs.columns if c not in keys]
    row = F.struct(*columns)
    return docs.groupBy(*keys).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("row")).select("row.*")


def without_rows(docs: DataFrame, fates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose keys are in ``fates`` (k1, k2, stays).

    Of the rows that share a key which stays, one does. ``fates`` is read more than once.
    """
    may, clear, keys = sifted(docs, fates, id_col, text_col)
    kept = clear.union(may.join(fates.select("k1", "k2").toDF(*keys), keys, "left_anti").select(*(quoted(c) for c in docs.columns)))
    repeated = fates.filter("stays").select("k1", "k2").toDF(*keys)
    if repeated.isEmpty():
        return kept
    return kept.union(one_of_each(may.join(repeated, keys, "left_semi"), keys))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of documents of about ``limit`` bytes.

    Yields (first row, row after last, bytes, offsets). A longer document is a
    run of its own; nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
