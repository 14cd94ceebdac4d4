"""Stupid-backoff scores of documents from corpus-wide n-gram counts.

The join of n-grams with their counts is relational, on hashed n-grams, with blocks
of documents as rows instead of single n-grams:

1. Documents are put into blocks of about ``BLOCK_BYTES`` of text (written once).
2. Each block explodes into the distinct n-grams of its words and their counts, dealt
   to buckets by the hash's leading bits. One row per block, order and bucket holds
   them as sorted numbers, so an n-gram that every document has is one number per block.
3. Each bucket of the count table sums its n-grams over all blocks, order by order, and
   answers every block with the totals. Hashes spread n-grams evenly; the number of
   buckets grows with the corpus, so that a bucket stays within about ``BUCKET_BYTES``.
4. Answers meet their block's texts again (a cogroup on the block, both sides sorted),
   and scores are summed per document.

There are never more rows than n-grams of blocks, and as long as blocks times buckets
is small beside those, far fewer. As both grow with the corpus, rows a GB grow in
proportion to it until then: by the constants below some 11,000 a GB at 0.5 GB and
700,000 a GB at 30 GB.

A document does not vouch for itself: its own counts are taken off. With counts c and
n words elsewhere, the score of a word after its context is c(context word) /
c(context) if that n-gram occurs elsewhere, else ``BACKOFF`` times the score after the
shorter context; a word alone scores max(c, 0.5) / n. The document's score is the
mean of the logarithms.

Counts are exact up to collisions of ``HASH_BITS`` bits: of N different n-grams about
N / 2^56 of them share their hash with another, 1e-7 at 30 GB and 1e-4 at 100 TB. Words are as in the near-duplicate
operator: A-Z in lower case, separated by white space.

Defined results
    null, empty, wordless text   0 words, scores 0
    very long text               a block of its own
    null id                      stays null
    repeated rows, equal texts   each row counts and is scored
    empty table                  empty result
    extra columns                are not read, so their names cannot clash
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import KERNEL_BYTES, documents, mix64, ship, small_batches, stage, text_chunks
from proofset.llm.near_dedup import word_hashes

ORDER, BACKOFF = 3, 0.4
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: Words of a block that are hashed or scored at a time, about.
RUN_WORDS = 1 << 17
#: Bits of an n-gram's hash.
HASH_BITS = 56
#: Compression of texts, and of numbers' upper bytes, counts and totals.
TEXT_LEVEL, NUMBER_LEVEL = 6, 1
_U = np.uint64
_PLACE = mix64(np.arange(901, 917, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a block, taken in runs of about ``KERNEL_BYTES`` to keep its scratch arrays small."""
    out, before, lo = [np.zeros(0, _U)], [np.zeros(1, np.int64)], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + KERNEL_BYTES, side="right")) - 1)
        words, ahead = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out.append(words)
        before.append(ahead[1:] + before[-1][-1])
        lo = hi
    return np.concatenate(out), np.concatenate(before)


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[tuple[pa.Array, np.ndarray, np.ndarray]]]:
    """Runs of (ids, bytes, offsets) of about ``limit`` bytes, across batches (id, text); a longer text is a run of its own."""
    held, size = [], 0
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column(1), min(limit, KERNEL_BYTES)):
            if held and size + len(data) > limit:
                yield held
                held, size = [], 0
            held.append((batch.column(0).slice(lo, hi - lo), data, offsets))
            size += len(data)
    if held:
        yield held


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, data, words): documents in blocks, in input order; data is their compressed text."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, held in enumerate(gathered(batches, BLOCK_BYTES)):
            ids = pa.concat_arrays([i for i, _, _ in held])
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            words = sum(len(words_of(data, offsets)[0]) for _, data, offsets in held)
            sizes = np.concatenate([np.diff(offsets) for _, _, offsets in held])
            text = np.concatenate([data for _, data, _ in held])
            held.clear()
            squeezed = pa.Codec("zstd", compression_level=TEXT_LEVEL).compress(pa.py_buffer(text), asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), one(ids), one(pa.array(sizes, pa.int64())), pa.array([squeezed], pa.binary()), pa.array([words], pa.int64())],
                names=["block", "ids", "sizes", "data", "words"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(gather, "block long, ids array<long>, sizes array<long>, data binary, words long")


def block_words(sizes: pa.ListScalar, data: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text) of a block."""
    offsets = np.concatenate(([0], np.cumsum(sizes.values.to_numpy())))
    text = pa.decompress(data.as_buffer(), decompressed_size=int(offsets[-1]), codec="zstd")
    return words_of(np.frombuffer(text, dtype=np.uint8), offsets)


def grams(words: np.ndarray, before: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n from 1: hashes of the n-grams that end at each word, 0 where the text is too short for it.

    One n is held at a time, and hashed by ``RUN_WORDS``.
    """
    sums = np.zeros(len(words), _U)
    for k in range(order):
        ends = np.empty_like(sums)
        for a in range(0, len(words), RUN_WORDS):
            run = slice(a, a + RUN_WORDS)
            lo = max(a, k)
            sums[lo : a + RUN_WORDS] += words[lo - k : max(a + RUN_WORDS - k, 0)][: len(sums[lo : a + RUN_WORDS])] * _PLACE[k]
            ends[run] = np.maximum(mix64(sums[run] + _U(k)) >> _U(64 - HASH_BITS), _U(1))
        for j in range(k):
            at = before[:-1] + j
            ends[at[at < before[1:]]] = 0
        yield ends


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers but 0, in order, and how often each occurs. Sorts ``values`` in place."""
    values.sort()
    values = values[np.searchsorted(values, _U(1)) :]
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    first = np.flatnonzero(first)
    return values[first], np.diff(first, append=len(values))


def _squeezed(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=NUMBER_LEVEL).compress(data.tobytes(), asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers: how many, the first, and the steps' bytes by place, of which the upper ones compress."""
    steps = np.diff(values).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    plain = (int(values[-1] - values[0]) // max(len(steps), 1)).bit_length() // 8
    head = np.array([len(values), values[0], plain], dtype="<u8").tobytes()
    return head + planes[:plain].tobytes() + _squeezed(planes[plain:])


def unpacked(data: memoryview) -> np.ndarray:
    n, first, plain = np.frombuffer(data[:24], dtype="<u8")
    steps, plain = int(n) - 1, int(plain)
    planes, at = np.empty((8, steps), dtype=np.uint8), 24 + plain * steps
    planes[:plain] = np.frombuffer(data[24:at], dtype=np.uint8).reshape(plain, steps)
    if steps and plain < 8:
        upper = pa.decompress(data[at:], decompressed_size=(8 - plain) * steps, codec="zstd")
        planes[plain:] = np.frombuffer(upper, dtype=np.uint8).reshape(-1, steps)
    out = np.empty(int(n), dtype=_U)
    out[0] = first
    np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=_U, out=out[1:])
    out[1:] += first
    return out


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers: how many, how many are large, those, and all as compressed bytes, 255 where large."""
    large = np.flatnonzero(values >= 255)
    head = np.array([len(values), len(large)], dtype="<u8").tobytes()
    return head + values[large].astype("<u8").tobytes() + _squeezed(np.minimum(values, 255).astype(np.uint8))


def widened(data: memoryview) -> np.ndarray:
    n, large = map(int, np.frombuffer(data[:16], dtype="<u8"))
    at = 16 + 8 * large
    out = np.frombuffer(pa.decompress(data[at:], decompressed_size=n, codec="zstd"), dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[16:at], dtype="<u8").astype(np.int64)
    return out


def requests(blocked: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, block, n, grams, counts): n-grams of one n."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                for n, ends in enumerate(grams(*block_words(sizes, data), order), 1):
                    values, counts = distinct(ends)
                    if not len(values):
                        continue
                    bucket = (values >> _U(HASH_BITS - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
                    first = np.flatnonzero(np.diff(bucket, prepend=-1))
                    ends_at = np.append(first[1:], len(values))
                    rows = [(int(bucket[a]), block, n, packed(values[a:b]), narrow(counts[a:b])) for a, b in zip(first, ends_at, strict=True)]
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    names = ["bucket", "block", "n", "grams", "counts"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blocked.select("block", "sizes", "data").mapInArrow(explode, "bucket int, block long, n int, grams binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(block, n, bucket, totals): corpus-wide counts in the order of the request."""

    def total(table: pa.Table) -> pa.Table:
        at = np.argsort(table["n"].to_numpy(), kind="stable")
        table = table.take(pa.array(at))
        ns, totals = table["n"].to_numpy(), []
        for n in np.unique(ns):
            part = table.slice(int(np.searchsorted(ns, n)), int((ns == n).sum()))
            values = [unpacked(memoryview(g.as_buffer())) for g in part["grams"]]
            counts = np.concatenate([widened(memoryview(c.as_buffer())) for c in part["counts"]])
            _, where = np.unique(np.concatenate(values), return_inverse=True)
            sums = np.bincount(where, weights=counts).astype(np.int64)[where]
            ends = np.cumsum([0, *map(len, values)])
            totals += [narrow(sums[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": table["block"], "n": table["n"], "bucket": table["bucket"], "totals": pa.array(totals, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(total, "block long, n int, bucket int, totals binary")


def _without_own(where: np.ndarray, totals: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each n-gram's count elsewhere: its total less the times its own document has it."""
    _, inverse, times = np.unique(owner * len(totals) + where, return_inverse=True, return_counts=True)
    return totals[where] - times[inverse]


def block_scores(ends: Iterable[np.ndarray], before: np.ndarray, totals: Iterable[np.ndarray], all_words: int) -> np.ndarray:
    """Summed log scores of a block's documents; ``totals`` of each n in the order of its n-grams.

    Documents are scored by runs of about ``RUN_WORDS``, so that only the n-grams, their totals and
    a count and score for each word are as long as the block.
    """
    sizes = np.diff(before)
    bounds = [0]
    while bounds[-1] < len(sizes):
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(before, before[bounds[-1]] + RUN_WORDS, side="right")) - 1))
    score, counts = np.zeros(before[-1]), np.zeros(before[-1], np.int64)
    for k, (at, told) in enumerate(zip(ends, totals, strict=True)):
        values, _ = distinct(at.copy())
        told = np.append(told, 0)  # for texts too short for the n-gram
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            run = slice(before[lo], before[hi])
            mine = at[run]
            there = mine > 0
            by_value = np.argsort(mine)
            where = np.empty(len(mine), np.int64)
            where[by_value] = np.searchsorted(values, mine[by_value])
            where[~there] = len(values)
            owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            elsewhere = _without_own(where, told, owner)
            if k == 0:
                score[run] = np.log(np.maximum(elsewhere, 0.5) / np.maximum(all_words - sizes[lo:hi][owner], 1))
            else:
                context = np.concatenate(([0], counts[run][:-1]))[: len(mine)]
                known = np.log(np.maximum(elsewhere, 1) / np.maximum(context, 1))
                score[run] = np.where(there & (elsewhere > 0), known, score[run] + there * math.log(BACKOFF))
            counts[run] = elsewhere
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=score, minlength=len(sizes))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: id, n_words, log_score, score."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    blocked = stage(blocks(docs, id_col, text_col), "lm-blocks", compression="none")
    all_words = blocked.agg(F.sum("words")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, all_words * order * 6 / BUCKET_BYTES))))
    told = answers(requests(blocked, order, bits))

    def score(block: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        answered = answered.sort_by([("n", "ascending"), ("bucket", "ascending")])
        ns = answered["n"].to_numpy()

        def totals(n: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(widened(memoryview(x.as_buffer())) for x in answered["totals"].filter(pa.array(ns == n)))])

        for ids, sizes, data in zip(block["ids"], block["sizes"], block["data"], strict=True):
            hashes, before = block_words(sizes, data)
            words = np.diff(before)
            sums = np.zeros(len(words))
            if len(hashes):
                sums = block_scores(grams(hashes, before, order), before, map(totals, range(1, order + 1)), all_words)
            out.append(pa.table([ids.values, pa.array(words, pa.int64()), pa.array(sums), pa.array(sums / np.maximum(words, 1))], names=["id", "n_words", "log_score", "score"]))
        return pa.concat_tables(out)

    texts = blocked.select("block", "ids", "sizes", "data").groupBy("block")
    return texts.cogroup(told.groupBy("block")).applyInArrow(score, "id long, n_words long, log_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
