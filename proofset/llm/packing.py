"""Best-fit-decreasing packing of token sequences.

Tokenising and cutting run per Arrow batch. What packing needs is only how many
pieces each length has: at most ``capacity`` numbers, whatever the input. From
them the driver runs best-fit decreasing over the whole corpus at once: a
segment tree over remaining capacities (a leaf per capacity, holding the bins
open there) finds the tightest bin that takes a length in logarithmic time, and
pieces of one length are placed in runs, so the plan has a few thousand rows.
Each piece then finds its sequence and offset from its length and its rank among
the pieces of that length. Ranks are taken per (length, hash bucket) on top of
counted bases, so that a length held by half of all pieces is dealt to many tasks.

Defined results
    null or empty text   one piece, the end token alone
    very long text       cut to pieces of ``capacity`` tokens, the first may be shorter
    ties                 pieces of equal length are interchangeable; ranks follow the id
    repeated rows        each row is packed by itself
    empty table          empty result
    extra columns        are not read, so their names cannot clash
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.llm.common import documents, ship, stage

CAPACITY = 1024
END_ID = 2
#: Hash buckets in which the pieces of one length are ranked.
RANK_BUCKETS = 256
#: Unicode's white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters whose kind depends on the Unicode version, as Python and ``tokenizers`` have different ones.
UNSETTLED = r"\u1c89\u1c8a\ua7cb-\ua7dc\U00010000-\U0001f10c\U0001fbf0-\U0010ffff"
#: Words whose ids a worker remembers, and the length up to which it does.
KNOWN_WORDS = 1 << 18
KNOWN_LETTERS = 32
#: Letters of the texts whose new words are encoded together.
RUN_LETTERS = 1 << 19


def _edges(major: str) -> np.ndarray:
    """Rows (first, after last) of the basic plane's characters of a major category."""
    of = [unicodedata.category(chr(c))[0] == major for c in range(1 << 16)]
    return np.flatnonzero(np.diff(of, prepend=False, append=False)).reshape(-1, 2)


@cache
def pre_tokens() -> re.Pattern:
    """The words of byte-level vocabularies: contractions, letters, numbers, signs, spaces."""
    letters, numbers = ("".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in _edges(k)) for k in "LN")
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


SIGN, LETTER, NUMBER, BLANK, UNSURE = 0, 1, 2, 3, 4


@cache
def kinds() -> np.ndarray:
    """By code point, the kind that ``pre_tokens`` sees; ``UNSURE`` is added where Unicode's versions differ."""
    out = np.full(0x110000, SIGN, np.uint8)
    for kind, major in ((LETTER, "L"), (NUMBER, "N")):
        for a, b in _edges(major):
            out[a:b] = kind
    for kind, of in ((BLANK, SPACE), (UNSURE, UNSETTLED)):
        ends = re.findall(r"\\U[0-9a-f]{8}|\\u[0-9a-f]{4}|\\x[0-9a-f]{2}|\\.|-|.", of)
        points = [ord(x if len(x) == 1 else x.encode().decode("unicode_escape")) if x != "-" else None for x in ends]
        for at, c in enumerate(points):
            if c is not None:
                last = points[at + 2] if points[at + 1 : at + 2] == [None] else c
                out[c : last + 1] = kind | (out[c : last + 1] if kind == UNSURE else 0)
    return out


def word_starts(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of ``pre_tokens`` begin in texts that stand in a row, text ``i`` from ``offsets[i]`` on."""
    n = len(points)
    first = np.zeros(n + 3, dtype=bool)  # of a text; beyond the end too
    first[offsets] = True
    first[n:] = True
    blank, space = kind == BLANK, points == 32
    start = first[: n + 3].copy()
    start[1:n] |= (kind[1:] != kind[:-1]) & ~space[:-1]
    # A run of blanks ahead of a word leaves its last one to the word, or by itself.
    start[1:n] |= blank[1:] & (~blank[:-1] | ~np.append(blank[2:], True) & ~first[2 : n + 1])
    marks = np.flatnonzero(points == 39)
    marks = marks[start[marks] & ~first[marks + 1]]
    one, two = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "sdmt"])
    long = ~first[marks + 2] & ((one == 108) & (two == 108) | np.isin(one, [ord("v"), ord("r")]) & (two == 101))
    start[marks[short | long] + 1] = False
    start[marks[short] + 2] = start[marks[long] + 3] = True
    return np.flatnonzero(start[:n])


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts by ``tokenizers``.

    Byte-level BPE merges within a word only, so a text's ids are those of its words
    in a row, and a worker remembers the ids of words it has met. Texts are taken in runs:
    words are cut and told apart as arrays, only a run's distinct words become strings,
    and its new words are encoded together. A full memory is emptied, so that it is
    bounded by that size and one run. Texts with a special token
    or a character that Unicode's versions class apart are encoded as a whole, and so
    are all texts of a vocabulary of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(Path(path).read_bytes())
        split = made["pre_tokenizer"] or {}
        by_words = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        self.by_words = by_words and made["model"]["type"] == "BPE" and not made["normalizer"]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        special = "|".join(map(re.escape, self.specials))
        self.whole = re.compile(f"[{UNSETTLED}]|{special or '(?!)'}")
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin with a space.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        #: Numbers of words; by number, where a word's ids begin and how many it has.
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of ``texts``; by word, which of these it is; by text, its first word's place (and the end);
        and whether it is to be encoded as a whole."""
        joined = "".join(texts)
        offsets = np.cumsum([0, *map(len, texts)])
        utf8 = np.frombuffer(joined.encode(), np.uint8)
        points = utf8 if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = kinds()[points]
        unsure = np.flatnonzero(kind >= UNSURE)
        whole = np.zeros(len(texts), dtype=bool)
        whole[np.searchsorted(offsets, unsure, side="right") - 1] = True
        if any(s in joined for s in self.specials):
            whole |= [any(s in t for s in self.specials) for t in texts]
        kind[unsure] -= UNSURE
        starts = word_starts(points, kind, offsets)
        bounds = np.searchsorted(starts, offsets)
        starts = np.append(starts, len(points))
        if points is not utf8:
            more = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
            starts = starts + np.append(0, np.cumsum(more, dtype=np.int64))[starts]
        found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(utf8))
        of = np.repeat(whole, np.diff(bounds))
        if of.any():  # their words are not asked for
            found = found.filter(pa.array(~of))
            bounds = np.append(0, np.cumsum(np.diff(bounds) * ~whole))
        found = found.dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), bounds, whole

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of ``words`` in a row; by word, where they begin and how many there are.

        Words of a space and letters are encoded as one text, as they fall apart before
        their spaces, and so do their ids; the others one by one.
        """
        spaced = np.array([w[0] == " " and w[1:].isalpha() for w in words], dtype=bool)
        text = "".join(w for w, s in zip(words, spaced, strict=True) if s)
        joined = [] if self.whole.search(text) else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.asarray(joined, dtype="<u4")
        firsts = np.flatnonzero(self.spaced[ids])
        if len(firsts) != spaced.sum():
            spaced[:], ids, firsts = False, ids[:0], firsts[:0]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, s in zip(words, spaced, strict=True) if not s], add_special_tokens=False)]
        lengths = np.zeros(len(words), np.int64)
        lengths[spaced] = np.diff(firsts, append=len(ids))
        lengths[~spaced] = [len(x) for x in found]
        starts = np.zeros(len(words), np.int64)
        starts[spaced] = firsts
        starts[~spaced] = len(ids) + np.cumsum(lengths[~spaced]) - lengths[~spaced]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(found), "<u4")]), starts, lengths

    def run(self, texts: list[str]) -> list[np.ndarray]:
        by_library = lambda text: np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not self.by_words:
            return [by_library(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        words, which, bounds, whole = self.words(texts)
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(number < 0)]
        short, long = [w for w in new if len(w) <= KNOWN_LETTERS], [w for w in new if len(w) > KNOWN_LETTERS]
        base = len(self.starts)
        self.known.update(zip(short, range(base, base + len(short)), strict=True))
        at_long = {w: i for i, w in enumerate(long, base + len(short))}
        number[number < 0] = [at_long[w] if len(w) > KNOWN_LETTERS else self.known[w] for w in new]
        for some in (short, long):  # long ones are known in this run only: their ids come last and go again
            kept = len(self.ids), len(self.starts)
            if some:
                ids, starts, lengths = self.learn(some)
                self.starts = np.concatenate([self.starts, starts + len(self.ids)])
                self.lengths = np.concatenate([self.lengths, lengths])
                self.ids = np.concatenate([self.ids, ids])
        number = number[which]
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[number] - ends + lengths, lengths) + np.arange(total)]
        bounds = np.append(0, ends)[bounds]
        if long:
            self.ids, self.starts, self.lengths = self.ids[: kept[0]].copy(), self.starts[: kept[1]], self.lengths[: kept[1]]
        return [by_library(t) if w else ids[a:b] for t, w, a, b in zip(texts, whole, bounds[:-1], bounds[1:], strict=True)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, by runs of about ``RUN_LETTERS``; a longer text is a run of its own."""
        run, size = [], 0
        for text in texts:
            if run and size + len(text) > RUN_LETTERS:
                yield from self.run(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        yield from self.run(run)

    def encode(self, text: str) -> np.ndarray:
        return list(self.encode_all([text]))[0]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    end = np.asarray([end_id], dtype="<u4")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path).encode_all
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            out: list[tuple] = []
            for doc, found in zip(ids, encode_all(t.as_py() or "" for t in batch.column(1)), strict=True):
                tokens = np.append(found, end)
                n, a, k = len(tokens), 0, 0
                while a < n:
                    b = a + ((n - a) % capacity or capacity)
                    out.append((doc, k, a, b - a, zlib.crc32(tokens[a:b])))
                    a, k = b, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class Capacities:
    """Segment tree over remaining capacities: the tightest one in use from a given size up."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Place ``counts[length]`` pieces of each length.

    Rows: (length, first rank, pieces, first sequence, pieces in each sequence,
    offset of the first). Bins with the same remaining capacity are kept as runs of
    sequence ids; pieces of one length fill a bin until it takes no more, as the
    bin just used is the tightest one.
    """
    tree = Capacities(capacity)
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity: (first sequence, bins)
    plan: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            open_runs[room].append((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, fresh, -(-left // (capacity // length))
                fresh += bins
            else:
                first, bins = open_runs[room].pop()
                tree.add(room, -bins)
            each = room // length
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
                first, bins = first + full, bins - full
            if left and bins:  # fewer pieces than one bin takes
                plan.append((length, rank, left, first, left, capacity - room))
                put(room - left * length, first, 1)
                first, bins, left = first + 1, bins - 1, 0
            put(room, first, bins)
    return plan


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    ship(spark)
    cut = stage(pieces(docs, id_col, text_col, path, capacity, end_id), "pack-pieces")
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    # At most capacity x RANK_BUCKETS rows, whatever the input.
    counts = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = stage(
        counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")), "pack-counts"
    )
    histogram = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(best_fit_decreasing(histogram, capacity))
    lengths = np.array([p[0] for p in plan], dtype=np.int64)
    starts = np.array([p[1] for p in plan], dtype=np.int64)
    rest = np.array([p[2:] for p in plan], dtype=np.int64).reshape(-1, 4)
    from_row = np.searchsorted(lengths, np.arange(capacity + 2))

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start")).cast("long") - 1
    ranked = bucketed.withColumn("rank", rank).join(bases.select("length", "bucket", "base"), ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            row = np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                of = length == value
                a, b = from_row[value], from_row[value + 1]
                row[of] = a + np.searchsorted(starts[a:b], rank[of], side="right") - 1
            inside = rank - starts[row]
            each = rest[row, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(rest[row, 1] + inside // each), pa.array(rest[row, 3] + inside % each * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
