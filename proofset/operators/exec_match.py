"""Execution match: run two queries and compare their results.

Results compare by position, not by column name; numbers as doubles rounded to two
places; as bags, unless the gold text has ORDER BY (anywhere: the rule is textual).
A bag compares by one aggregation of both sides, a list by rows with their position.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField, StructType

from proofset.functions import text as tx
from proofset.sources.records import cut, scratch_path

T = TypeVar("T")
Item = TypeVar("Item")
#: What a statement may take where its caller names no limit, in seconds.
LIMIT_SECONDS = 60.0
#: Statements that run side by side.
WORKERS = 4
#: Statements whose answers the driver holds at a time.
SLICE = 512
#: What Spark raises for statements that fail, when analysed or when run.
FAILURES = (PySparkException, Py4JJavaError)
#: Spark's conditions by kind of failure.
ERROR_KINDS = {
    "UNRESOLVED_COLUMN": "hallucinated_column",
    "UNRESOLVED_FIELD": "hallucinated_column",
    "TABLE_OR_VIEW_NOT_FOUND": "hallucinated_table",
    "PARSE_SYNTAX_ERROR": "syntax_error",
    "PARSE_EMPTY_STATEMENT": "syntax_error",
}


class GoldError(ValueError):
    """The reference query itself fails."""


def constant(spark: SparkSession, *columns: Column) -> Row:
    """The values of expressions over no table, which the optimiser folds: no job runs."""
    return spark.sql("VALUES (1)").select(*columns).first()


def failure(e: BaseException) -> str:
    """One line that names the kind of failure first."""
    if isinstance(e, PySparkException):
        return f"{e.getCondition() or type(e).__name__}: {str(e).splitlines()[0]}"
    root = getattr(e, "java_exception", None)
    while root is not None and root.getCause() is not None:
        root = root.getCause()
    said = type(e).__name__ if root is None else root.getClass().getSimpleName()
    return f"{said}: {(str(e) if root is None else root.getMessage() or '').splitlines()[:1]}"


def guard(spark: SparkSession, sql: str) -> str | None:
    """Why the statement may not run, or None. Spark runs DDL eagerly, so this comes first."""
    if not sql.strip():
        return "empty"
    allowed = constant(spark, tx.is_read_only(F.lit(sql)).alias("ok")).ok
    return None if allowed else "refused: not one read-only statement"


def run_sql(spark: SparkSession, sql: str) -> tuple[DataFrame | None, str | None]:
    """(result, None) or (None, error). The result is analysed, not yet computed."""
    refused = guard(spark, sql)
    if refused:
        return None, refused
    try:
        return spark.sql(sql.strip().rstrip(";")), None
    except FAILURES as e:
        return None, failure(e)


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> tuple[T | None, str | None]:
    """(result of ``action``, None), or (None, error) once its Spark jobs took over ``seconds``.

    Jobs carry a tag and are interrupted by it, those that start too late as well. A task
    ends at its next check for interruption.
    """
    tag, done, late = f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)
            wait = 0.2

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        return action(), None
    except Exception:
        if late.is_set():
            return None, f"timeout: over {seconds:g} s"
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def attempt(spark: SparkSession, action: Callable[[], T], seconds: float = LIMIT_SECONDS) -> tuple[T | None, str | None]:
    """(result of ``action``, None) or (None, error): a statement's failure and its time limit are results."""
    try:
        return within(spark, seconds, action)
    except FAILURES as e:
        return None, failure(e)


def run_rows(spark: SparkSession, sql: str, rows: int, seconds: float = LIMIT_SECONDS) -> tuple[list | None, str | None]:
    """(at most ``rows`` rows, None) or (None, error), within a time limit."""
    df, error = run_sql(spark, sql)
    return (None, error) if df is None else attempt(spark, df.limit(rows).collect, seconds)


def side_by_side(spark: SparkSession, items: Iterable[Item], action: Callable[[Item], T], seconds: float | Callable[[Item], float] = LIMIT_SECONDS, workers: int = WORKERS, told: Callable[[T], str | None] = lambda _: None) -> list[tuple[T | None, str | None]]:
    """``attempt`` of each item, in order, by a bounded number of threads that submit jobs.

    ``told`` gives the error that a result tells of, where ``action`` has limits within.

    Each attempt has a tag and a limit of its own, which may depend on the item. What ran out of time beside others
    is attempted again alone, and then in the other order, as a statement that hangs may
    have held all slots and its tasks need a while to end; so it costs its own result only. Each thread has a scheduler pool of its own: with
    ``spark.scheduler.mode`` FAIR free slots are shared.
    """
    pools = iter([f"statements-{i}" for i in range(workers)])
    start = inheritable_thread_target(spark)(lambda: spark.sparkContext.setLocalProperty("spark.scheduler.pool", next(pools)))
    items = list(items)
    limit = seconds if callable(seconds) else lambda _: seconds
    with ThreadPoolExecutor(workers, initializer=start) as pool:
        ran = list(pool.map(lambda item: attempt(spark, lambda: action(item), limit(item)), items))
    # A job that another one's threads submitted may be cancelled along with that one.
    late = re.compile("^timeout: over|SPARK_JOB_CANCELLED")
    for order in (1, -1) if len(items) > 1 else ():
        for i in [i for i, (found, error) in enumerate(ran) if late.search(error or told(found) or "")][::order]:
            ran[i] = attempt(spark, lambda i=i: action(items[i]), limit(items[i]))
    return ran


def answered(keys: DataFrame, action: Callable[[Row], tuple], schema: str, seconds: float = LIMIT_SECONDS, workers: int = WORKERS, told: Callable[[tuple], str | None] = lambda _: None) -> DataFrame:
    """``keys`` with the values (``schema``) that ``action`` gives for each row, and ``failure``.

    Rows come to the driver in slices of ``SLICE``, as statements need a session, and a
    slice's answers are written before the next one comes.
    """
    spark = keys.sparkSession
    keys, path = cut(keys), scratch_path(keys.sparkSession, "answers")
    values = StructType.fromDDL(schema)
    whole = StructType([*keys.schema, *values, StructField("failure", StringType())])
    spark.createDataFrame([], whole).write.parquet(path)
    left = keys.toLocalIterator()
    while part := list(islice(left, SLICE)):
        ran = side_by_side(spark, part, action, seconds, workers, told)
        rows = [(*k, *(found if error is None else [None] * len(values)), error) for k, (found, error) in zip(part, ran, strict=True)]
        spark.createDataFrame(rows, whole).write.mode("append").parquet(path)
    return spark.read.schema(whole).parquet(path)


def error_kind(error: str) -> str:
    return ERROR_KINDS.get(re.split(r"[.:]", error)[0], "other_sql_error")


def normal_cell(field: StructField) -> str:
    """In SQL: a number rounded to two places, everything else as text."""
    number = isinstance(field.dataType, NumericType | BooleanType)
    return f"round(CAST(`{field.name}` AS DOUBLE), 2) + 0.0e0" if number else f"CAST(`{field.name}` AS STRING)"


def normalised(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ...: numbers rounded to two places, everything else as text."""
    positional = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return positional.select(*(F.expr(normal_cell(f)).alias(f.name) for f in positional.schema))


def row_number_of(columns: Iterable[str]) -> str:
    """In SQL: 48 bits that stand for the JSON of a row of normal cells."""
    row = ", ".join(f"'{c}', `{c}`" for c in columns)
    return f"CAST(conv(substring(md5(to_json(named_struct({row}), map('ignoreNullFields', 'false'))), 1, 12), 16, 10) AS BIGINT)"


def total_of(number: Column) -> Column:
    """The sum of row numbers as text, exact for any number of rows. Halves are summed, as longs are quicker than decimals."""
    high, low = (F.coalesce(F.sum(half), F.lit(0)).cast("decimal(30,0)") for half in (F.shiftright(number, 24), number.bitwiseAND((1 << 24) - 1)))
    return (high * F.lit(1 << 24) + low).cast("decimal(30,0)").cast("string")


def filled(columns: Iterable[str]) -> str:
    """In SQL: whether any cell of a row is not null."""
    return f"coalesce({', '.join(f'CAST(`{c}` AS STRING)' for c in columns)}) IS NOT NULL"


def with_position(df: DataFrame) -> DataFrame:
    """``df`` with its row number ``__pos`` in output order.

    Rows are numbered within partitions; the partitions' sizes, one row each, give
    the bases.
    """
    marked = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    base, bases = 0, {}
    for r in sorted(sizes, key=lambda r: r.p):
        bases[r.p], base = base, base + r.n
    if not bases:
        return marked.select("*", F.lit(0).cast("long").alias("__pos")).drop("__id")
    table = F.create_map(*(F.lit(int(x)) for kv in bases.items() for x in kv))
    return marked.withColumn("__pos", table[part] + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def is_ordered(gold: str) -> bool:
    return "order by" in gold.lower()


def differences(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows of normalised ``a`` and ``b`` that don't match: the row, n_a and n_b."""
    if ordered:
        a, b = with_position(a), with_position(b)
    keys = a.columns
    sides = a.withColumns({"__a": F.lit(1), "__b": F.lit(0)}).unionByName(b.withColumns({"__a": F.lit(0), "__b": F.lit(1)}))
    counted = sides.groupBy(*keys).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"))
    return counted.filter("n_a <> n_b")


def same_result(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    a, b = normalised(a), normalised(b)
    apart = [c for c in a.columns if a.schema[c].dataType != b.schema[c].dataType]
    if apart:  # a column of nulls has no type of its own
        filled = [df.agg(*(F.count(c).alias(c) for c in apart)).first() for df in (a, b)]
        if any(filled[0][c] and filled[1][c] for c in apart):
            return False
        a, b = (df.withColumns({c: F.col(c).cast("string") for c in apart}) for df in (a, b))
    return differences(a, b, ordered).isEmpty()


def signature(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row: rows, rows with a value, and a sum over row hashes that no partitioning changes;
    nor does the order of rows, unless it counts, when hashes are of rows with their positions."""
    flat = normalised(df)
    some = F.count_if(F.expr(filled(flat.columns))).alias("n_filled")
    flat = with_position(flat) if ordered else flat
    return flat.agg(F.count(F.lit(1)).alias("n_rows"), some, total_of(F.expr(row_number_of(flat.columns))).alias("signature"))


@dataclass
class ExecInfo:
    executes: bool
    error: str | None
    n_rows: int
    n_cols: int
    correct: bool
    read_only: bool
    gold_rows: int | None = None
    gold_cols: int | None = None


def _whole(df: DataFrame) -> int:
    """The number of rows, after all columns of all rows were computed and kept (a count may leave some out)."""
    df.persist().write.format("noop").mode("overwrite").save()
    return df.count()


class Matcher:
    """Scores statements against gold statements, whose results are kept; the least recently used goes first.

    No statement takes more than ``seconds``; one that fails or takes longer has no result.
    """

    def __init__(self, spark: SparkSession, keep: int = 4096, seconds: float = LIMIT_SECONDS):
        self.spark, self.keep, self.seconds = spark, keep, seconds
        self._gold: OrderedDict[str, DataFrame] = OrderedDict()
        self._lock = threading.Lock()

    def gold(self, sql: str) -> DataFrame:
        """The gold's result, computed once; ``GoldError`` if it fails at any point."""
        with self._lock:
            if sql in self._gold:
                self._gold.move_to_end(sql)
                return self._gold[sql]
        df, error = run_sql(self.spark, sql)
        if df is not None:
            _, error = attempt(self.spark, lambda: _whole(df), self.seconds)
        if error is not None:
            if df is not None:
                df.unpersist()
            raise GoldError(f"{error} in {sql!r}")
        with self._lock:
            self._gold[sql] = df
            while len(self._gold) > self.keep:
                self._gold.popitem(last=False)[1].unpersist()
        return df

    def matches(self, predicted: str, gold: str) -> bool:
        wanted = self.gold(gold)
        df, _ = run_sql(self.spark, predicted)
        return df is not None and attempt(self.spark, lambda: same_result(df, wanted, is_ordered(gold)), self.seconds)[0] is True

    def info(self, predicted: str, gold: str | None = None) -> ExecInfo:
        """All facts from one execution."""
        read_only = constant(self.spark, tx.is_read_only(F.lit(predicted)).alias("x")).x
        df, error = run_sql(self.spark, predicted)
        out = ExecInfo(False, error, 0, 0, False, bool(read_only))
        if gold is not None:
            wanted = self.gold(gold)
            out.gold_rows = wanted.count()
            out.gold_cols = len(wanted.columns) if out.gold_rows else 0
        if df is None:
            return out
        n, out.error = attempt(self.spark, lambda: _whole(df), self.seconds)
        if out.error is None:
            out.executes, out.n_rows, out.n_cols = True, n, len(df.columns) if n else 0
            if gold is not None:
                same, out.error = attempt(self.spark, lambda: same_result(df, wanted, is_ordered(gold)), self.seconds)
                out.correct = same is True
        df.unpersist()
        return out


def parses(spark: SparkSession, sql: str) -> bool:
    """A syntax check only: names are not resolved."""
    if not sql.strip():
        return False
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        if "Parse" in type(e).__name__ or "PARSE" in str(e):
            return False
        raise
    return True


def cross_check(matcher: Matcher, golds: list[str]) -> DataFrame:
    """(i, j, agree) over all pairs of a bounded list of gold texts, by signature."""
    frames = [signature(matcher.gold(g)).select(F.lit(i).alias("i"), "n_rows", "signature") for i, g in enumerate(golds)]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    other = out.toDF("j", "m_rows", "m_signature")
    pairs = out.join(other, F.col("i") <= F.col("j"))
    return pairs.select("i", "j", ((F.col("n_rows") == F.col("m_rows")) & (F.col("signature") == F.col("m_signature"))).alias("agree"))
