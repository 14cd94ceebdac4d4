"""Periodic runs of words: maximal stretches that repeat a period four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least max(``LEAST``, ``TIMES`` * q) words, which no neighbouring word
extends. A worker takes a chunk of about a megabyte of texts at a time:

1. Words get numbers by exact comparison, and the chunk prefix hashes (sums of
   random values times powers of a base, modulo 2^64).
2. Harmonic grid: for each text of n words and period q up to n / TIMES, the grid
   points are the multiples of q, about n ln n in all. A run of period q holds at least
   three consecutive grid points whose words equal those one period later; pairs
   (period, grid point) that start no such triple are not looked at again.
3. For all remaining pairs at once, binary searches on prefix hashes find how far words
   equal those a period later, to the right and to the left (longest common extension).
   That is the stretch around the grid point; long enough ones are candidates.
4. Candidates are verified on word numbers, inside and at both ends. A text with a
   candidate that isn't what hashes said is done again by comparing all its words for
   each period, so results never depend on hashes.
5. Of candidates with the same stretch the smallest period is the run's.

Pairs are taken in batches of bounded size, so memory is bounded by one text. There is
no shuffle: a text is one record.

Defined results
    null, empty text   no words, no runs, collapsed text empty
    very long text     processed whole, in a chunk of its own
    null id            processed like any other
    ties               the best run is the one of greatest length / period, then smallest
                       start, then smallest period
    repeated rows      each row has its result
    empty table        empty result
    extra columns      are not read, so their names cannot clash
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import documents, mix64, quoted, ship, text_chunks

LEAST, TIMES = 6, 4
#: (period, grid point) pairs that are handled at a time.
PAIRS = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _starts(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _grid(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point) of all pairs, in batches of about ``PAIRS``."""
    n = end - first
    periods = n // TIMES
    text = np.repeat(np.arange(len(n)), periods)
    q = _starts(periods) + 1
    points = n[text] // q
    done = np.cumsum(points)
    at = 0
    while at < len(q):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
        t, p, many = text[at:upto], q[at:upto], points[at:upto]
        yield np.repeat(t, many), np.repeat(p, many), np.repeat(first[t], many) + _starts(many) * np.repeat(p, many)
        at = upto


def _candidates(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distinct (text, start, end, period) of stretches that hashes hold for long enough."""
    values = mix64(words.astype(_U) + _U(1))
    powers = np.full(len(words) + 1, _BASE, dtype=_U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    prefix = np.concatenate((np.zeros(1, _U), np.cumsum(values * powers[:-1], dtype=_U)))

    def longest(low: np.ndarray, high: np.ndarray, q: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
        """The greatest k in low..high for which k words at ``at`` (side 1) or before it
        (side -1) equal those a period later; ``low`` is known to hold."""
        while len(open_ := np.flatnonzero(low < high)):
            k = (low[open_] + high[open_] + 1) >> 1
            a = at[open_] if side > 0 else at[open_] - k
            b = a + k
            d = q[open_]
            holds = (prefix[b] - prefix[a]) * powers[d] == prefix[b + d] - prefix[a + d]
            low[open_[holds]] = k[holds]
            high[open_[~holds]] = k[~holds] - 1
        return low

    found = []
    for text, q, at in _grid(first, end):
        inside = np.flatnonzero(at + 3 * q < end[text])
        at_, q_ = at[inside], q[inside]
        same = (words[at_] == words[at_ + q_]) & (words[at_ + q_] == words[at_ + 2 * q_])
        inside, at_, q_ = inside[same], at_[same], q_[same]
        inside = inside[words[at_] == words[at_ + 3 * q_]]
        text, q, at = text[inside], q[inside], at[inside]
        if not len(at):
            continue
        right = longest(np.zeros_like(at), end[text] - q - at, q, at, 1)
        left = longest(np.zeros_like(at), at - first[text], q, at, -1)
        begin, stop = at - left, at + right + q
        enough = stop - begin >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack((text, begin, stop, q))[:, enough], axis=1))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)


def _holds(words: np.ndarray, first: int, end: int, begin: int, stop: int, q: int) -> bool:
    """Whether words begin..stop have period q, and no neighbour extends that."""
    if begin > first and words[begin - 1] == words[begin - 1 + q]:
        return False
    if stop < end and words[stop] == words[stop - q]:
        return False
    return bool((words[begin : stop - q] == words[begin + q : stop]).all())


def _exact(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of a text's stretches, by comparing all words for each period."""
    out = []
    for q in range(1, len(words) // TIMES + 1):
        same = np.concatenate(([False], words[:-q] == words[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        out += [(b, e + q, q) for b, e in edges.tolist() if e + q - b >= max(LEAST, TIMES * q)]
    return out


def runs_of(words: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each text (numbers of its words): (start, length, period) by start, then period."""
    first, end = offsets[:-1], offsets[1:]
    stretches: list[list[tuple[int, int, int]]] = [[] for _ in first]
    wrong = set()
    for text, begin, stop, q in _candidates(words, first, end).T.tolist():
        base = int(first[text])
        if text not in wrong and not _holds(words, base, int(end[text]), begin, stop, q):
            wrong.add(text)
        stretches[text].append((begin - base, stop - base, q))
    for text in wrong:
        stretches[text] = _exact(words[first[text] : end[text]])
    out = []
    for found in stretches:
        smallest: dict[tuple[int, int], int] = {}
        for begin, stop, q in found:
            smallest[begin, stop] = min(q, smallest.get((begin, stop), q))
        out.append(sorted((begin, stop - begin, q) for (begin, stop), q in smallest.items()))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for begin, length, q in runs:
        change[begin + q] += 1
        change[begin + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (by start, then period), collapsed text."""
    ship(docs.sparkSession)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                # bytes.split takes exactly the separators 0x20 and 0x09 to 0x0D.
                texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ends = np.cumsum([0, *map(len, texts)])
                numbers: dict[bytes, int] = {}
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(ends[-1]))
                runs = runs_of(words, ends)
                flat = np.array([r for f in runs for r in f], dtype=np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), fields)
                collapsed = pa.array([_collapsed(t, f).decode() for t, f in zip(texts, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends), pa.int64()), lists, collapsed], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(read, f"id long, n_words long, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, then of smallest start, then period; null if none."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))
        return F.when((x > y) | ((x == y) & earlier), a).otherwise(b)

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(0))), F.get(runs, 0), better)


#: White space between words.
SPACES = r"[\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where every tenth text by its id's checksum ends in a repeated stretch.

    With h the checksum and g = h div 10, words from a = g mod n on repeat those from a
    on with period 1 + (n - a) div (3 + g mod 8). Rows without an id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("tenth"), F.floor(h / 10).alias("g"))
    words = F.array_remove(F.split("text", SPACES), "")
    chosen = chosen.withColumn("w", F.when(F.col("tenth"), words)).withColumn("n", F.size("w").cast("long"))
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(documents(spark, sf_dir))).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
