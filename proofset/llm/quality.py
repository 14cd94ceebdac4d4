"""Quality classifier: a regularised quadratic discriminant on document statistics.

Statistics of whole texts are taken once per document, by byte tables and segment
sums over runs of about 256 kB, transformed (logs, square roots) and written.
The fit joins the small rows of statistics with the labels and sums moments per
class on the executors; only those sums (a few kB per class) reach the driver.
Class covariances shrink towards the pooled one and the identity; their Cholesky
factors, computed once, give Mahalanobis distances and log determinants. The score
is the logistic of the tempered log-density difference.

Defined results
    null or empty text   statistics of the empty text; scored like any other
    very long text       read whole, in a run of its own
    null id              trains if labelled (it can't be), is scored
    repeated rows        equal texts, equal scores
    empty table          empty result; without two classes of labels every score is
                         the share of label 1 (0.5 without labels)
    null labels          do not train
    extra columns        ``keep_good`` keeps them; the rest are not read
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import documents, id_remainder, mix64, ship, stage, table, text_chunks

#: Share of the pooled covariance, and of the identity (in standardised units).
POOLED, IDENTITY = 0.2, 0.05
#: The log-density difference is divided by this before the logistic.
TEMPERATURE = 8.0
FOLDS, HELD_OUT = 3, 1
#: Bytes of text whose statistics are taken at a time: their arrays stay in a core's cache.
RUN_BYTES = 1 << 18

_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "wide": _BYTES >= 128,
    "space": np.isin(_BYTES, [32, 9, 10, 11, 12, 13]),
    "line": _BYTES == 10,
    "stop": np.isin(_BYTES, [46, 63]),
    "shout": _BYTES == 33,
    "comma": np.isin(_BYTES, [44, 59, 58]),
    "bar": _BYTES == 124,
    "symbol": np.isin(_BYTES, [35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126, 43, 91, 93, 47]),
}
NAMES = ("upper", "lower", "digit", "wide", "stop", "shout", "comma", "bar", "symbol", "length", "word", "line", "lines", "again", "capital", "same", "spaces")
D = len(NAMES)
#: One weight per byte value: a byte's class counts sit in 6 bits of a wide sum.
_CLASSES = list(_IS)
_MIXED = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _segment(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each [offsets[i], offsets[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Share of a document's bytes in lines that it has had before."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(lines) + 1
    starts = np.unique(np.concatenate((offsets[:-1][offsets[:-1] < offsets[1:]], breaks[breaks < len(data)])))
    if not len(starts):
        return np.zeros(n)
    lengths = np.diff(starts, append=len(data))
    place = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    values = np.where(lines, np.uint64(0), _MIXED[data] * (place * np.uint64(2) + np.uint64(1)))
    hashes = np.add.reduceat(values, starts)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    order = np.lexsort((hashes, owner))
    repeat = np.zeros(len(starts), dtype=bool)
    repeat[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return np.bincount(owner, weights=lengths * repeat * (lengths > 8), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics (rows of ``NAMES``) of the texts in ``data``."""
    size = np.diff(offsets).astype(float)
    is_ = {k: table[data] for k, table in _IS.items()}
    count = {k: _segment(v, offsets).astype(float) for k, v in is_.items()}
    begin = ~is_["space"]
    begin[1:] &= is_["space"][:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = ~is_["space"][heads]
    words = np.maximum(_segment(begin, offsets), 1)
    capitals = _segment(begin & is_["upper"], offsets)
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (data[1:] == data[:-1]) & ~is_["space"][1:]
    spaces = np.zeros(len(data), dtype=bool)
    spaces[1:] = is_["space"][1:] & is_["space"][:-1]
    n = np.maximum(size, 1)
    ratio = lambda k: np.sqrt(count[k] / n)
    lines = count["line"] + 1
    columns = [ratio(k) for k in NAMES[:9]]
    columns += [
        np.log1p(size),
        np.log1p((size - count["space"]) / words),
        np.log1p(size / lines),
        np.log1p(lines),
        np.sqrt(_repeated_lines(data, offsets, is_["line"]) / n),
        np.sqrt(capitals / words),
        np.sqrt(_segment(same, offsets) / n),
        np.sqrt(_segment(spaces, offsets) / n),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Cached factors: per class the mean, inverse Cholesky factor and constant, in standardised units."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -700, 700)))


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """``moments``: per label (rows, sum of x, sum of outer products)."""
    rows = {k: m[0] for k, m in moments.items()}
    total = sum(rows.values())
    if any(rows.get(k, 0) < 2 for k in (0, 1)):
        share = rows.get(1, 0) / total if total else 0.5
        return Model(np.zeros(D), np.ones(D), [], [], [], share)
    s, q = sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values())
    centre = s / total
    scale = np.sqrt(np.maximum(np.diag(q) / total - centre**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    means, covariances = [], []
    for k in (0, 1):
        n, s, q = moments[k]
        mean = s / n
        covariances.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = sum(rows[k] * c for k, c in enumerate(covariances)) / total
    inverses, constants = [], []
    for k, own in enumerate(covariances):
        mixed = (1 - POOLED - IDENTITY) * own + POOLED * pooled + IDENTITY * np.eye(D)
        factor = np.linalg.cholesky(mixed)
        inverses.append(np.linalg.inv(factor))
        constants.append(float(np.log(rows[k] / total) - np.log(np.diag(factor)).sum()))
    return Model(centre, scale, means, inverses, constants, rows[1] / total)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fit on the labelled rows of ``stats`` that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (id_remainder(F.col("id"), FOLDS) != HELD_OUT)).distinct()
    rows = stats.join(known, "id").select("y", "x")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0.0, np.zeros(D), np.zeros((D, D))] for k in (0, 1)}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            for k, m in sums.items():
                own = x[y == k]
                m[0] += len(own)
                m[1] += own.sum(axis=0)
                m[2] += own.T @ own
        yield pa.RecordBatch.from_pydict({"y": list(sums), "m": [[m[0], *m[1], *m[2].ravel()] for m in sums.values()]}, schema=pa.schema([("y", pa.int32()), ("m", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(add, "y int, m array<double>")
    # Two rows a task, of fixed size; summed by position before they come.
    summed = parts.select("y", F.posexplode("m").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    moments: dict[int, np.ndarray] = reduce(lambda d, r: d[r.y].__setitem__(r.at, r.v) or d, summed, {k: np.zeros(1 + D + D * D) for k in (0, 1)})
    return fit_moments({k: (m[0], m[1 : 1 + D], m[1 + D :].reshape(D, D)) for k, m in moments.items()})


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", "score"])

    return stats.mapInArrow(run, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    ship(docs.sparkSession)
    stats = stage(measured(docs, id_col, text_col), "quality-statistics")
    model = fit(stats, labels, label_col)
    return scored(stats, model).select(
        "id",
        (id_remainder(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows that score below 0.5; columns unchanged.

    The second pass scores rows in place, so that no text is shuffled.
    """
    ship(docs.sparkSession)
    stats = stage(measured(docs, id_col, text_col), "quality-statistics")
    model = fit(stats, labels, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at), RUN_BYTES):
                good = model.scores(statistics(data, offsets)) >= 0.5
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
