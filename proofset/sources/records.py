"""Record files and the keyed result store, through Spark's own readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that the cluster names; only a local master, as in tests, gets a
    temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='proofset-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, without its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; keys sorted, nulls written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_map_file(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A single JSON object of kind -> list of items, as rows (kind, item fields)."""
    from pyspark.sql import functions as F

    whole = spark.read.text(path, wholetext=True)
    kinds = whole.select(F.explode(F.from_json("value", f"map<string,array<struct<{item}>>>")).alias("kind", "items"))
    return kinds.select("kind", F.explode("items").alias("item")).select("kind", "item.*")


class ResultStore:
    """Results by key under the first of several folders; a missing key is None, never made up."""

    def __init__(self, spark: SparkSession, *roots: str):
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]

    def _path(self, root: str, key: str) -> str:
        parts = key.split("/")
        if not all(parts) or any(p in (".", "..") for p in parts):
            raise ValueError(f"bad key {key!r}")
        return f"{root}/{key}"

    def save(self, key: str, df: DataFrame) -> str:
        path = self._path(self.roots[0], key)
        df.write.mode("overwrite").parquet(path)
        return path

    def load(self, key: str) -> DataFrame | None:
        for root in self.roots:
            try:
                return self.spark.read.parquet(self._path(root, key))
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        return None

    def have(self, key: str) -> bool:
        return self.load(key) is not None
