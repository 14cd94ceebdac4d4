"""SentencePiece encoding and decoding with forward states shared by common prefixes.

A text is marked (a leading mark, marks for spaces) and cut into words, each with its
marks in front, and wherever else the vocabulary shows that no piece crosses a cut. The distinct new words of a chunk are sorted,
which lays them out as a trie in depth-first order: the forward states up to the
longest common prefix with the word before are reused, the rest are computed. Encodings
of words are kept in a memory of bounded size.

Unigram models: the forward state of a prefix is its best sum of scores, in single
precision as in the library, and the piece that ends it. The sums are a word's own; the
library adds up whole texts, so where two segmentations are within its rounding, it may
take another one.

BPE models (the vocabulary at hand): scores are merge ranks, and a best sum does not
give the ids. The forward state of a prefix is therefore the last piece of its BPE
segmentation: a piece t extends the segmentation of the prefix before it if its pair
with that prefix's last piece is stable, that is, if merging the pair's characters by
rank gives the pair again. A segmentation whose neighbours are all stable is the BPE
one, so exactly one state survives per prefix, as with Viterbi's best one. That needs
ranks that differ. Pieces that share the lowest rank, as runs of marks do, merge after
all others and from the left, so words that may have some are first segmented without
them; a last pass merges what is left. Models in which other pieces share a rank, of
other kinds, or that rewrite texts are refused.

Characters without a piece become their UTF-8 bytes' pieces.

Defined results
    null or empty text   no ids; decodes to the empty text
    very long text       encoded whole; one long word costs time in its length only
    null id              stays null
    ties                 BPE merges from the left; equal sums take the longer last piece
    repeated rows        equal texts, equal ids
    empty table          empty result
    extra columns        are not read, so their names cannot clash
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import documents, ship

MARK = "▁"
#: Words remembered in each of two generations, and pairs of pieces.
MEMORY_WORDS, MEMORY_PAIRS = 200_000, 1_000_000
#: Characters of the remembered words of a generation.
MEMORY_CHARS = 16 << 20
#: Characters without a piece are numbered from here within segmentations.
_UNKNOWN = 1 << 20
#: A unigram model's unknown character scores so much less than its worst piece (a fixed value).
UNKNOWN_PENALTY = 10.0
_LATIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Texts that are encoded at a time.
CHUNK_TEXTS = 512



def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(proto: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = proto[at], at + 1
            value, shift = value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(proto):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, proto[at : at + size]
        at += size


KINDS = {1: "unigram", 2: "bpe"}


def kind_of(proto: bytes) -> str:
    """``unigram`` or ``bpe``; other models, and those that rewrite texts, are refused.

    Numbers of fields: 2 the trainer (3 in it the kind), 3 the rewriting (2 in it the
    rules, 3 the mark in front, 4 the removal of spaces, 5 the marks for spaces).
    """
    fields = list(_fields(proto))
    trainer = dict(f for n, spec in fields if n == 2 for f in _fields(spec))
    rewriting = dict(f for n, spec in fields if n == 3 for f in _fields(spec))
    kind = KINDS.get(trainer.get(3, 1))
    if kind is None:
        raise ValueError("neither a unigram nor a BPE model")
    if rewriting.get(2) or not rewriting.get(3, 1) or rewriting.get(4, 1) or not rewriting.get(5, 1):
        raise ValueError("the model rewrites texts in a way that is not supported")
    return kind


class Memory(dict):
    """A mapping of bounded size in two generations: what is used lives on, the rest is let go."""

    old: dict = {}
    chars = 0

    def unknown(self, keys: set) -> set:
        if len(self) > MEMORY_WORDS or self.chars > MEMORY_CHARS:
            self.old = dict(self) if self.chars <= MEMORY_CHARS else {}
            self.chars = 0
            self.clear()
        found = keys.difference(self).difference(self.old)
        self.chars += sum(map(len, found))
        return found

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value


class Pieces:
    """A SentencePiece model's pieces, and words' encodings by shared prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind_of(sp.serialized_model_proto())
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.texts = {i: p for p, i in self.ids.items()}
        # Pieces that share the lowest rank; single characters are no merges.
        ranks = Counter(self.rank[p] for p in self.ids if len(p) > 1)
        lowest = max(self.rank.values(), default=0)
        self.late = {p for p in self.ids if len(p) > 1 and self.rank[p] == lowest and ranks[lowest] > 1}
        if self.kind == "bpe" and any(n > 1 for r, n in ranks.items() if r != lowest):
            raise ValueError("pieces above the lowest rank share one")
        self.late_letters = frozenset("".join(self.late))
        if self.kind == "bpe":
            self.early = {p: r for p, r in self.rank.items() if p not in self.late}
            known = {p: i for p, i in self.ids.items() if p not in self.late}
        else:
            known = self.ids
            self.scores = {i: np.float32(sp.get_score(i)) for i in plain}
            self.unknown_score = min(self.scores.values(), default=np.float32(0)) - np.float32(UNKNOWN_PENALTY)
        # Every ending of a piece, with the id of the piece that it is, or -1.
        self.tails = {p[k:]: -1 for p in known for k in range(len(p))} | known
        # Words also end where no piece can go on: around characters that no longer piece
        # has, and, if no piece joins Latin letters or digits with others, between those.
        loose = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids))
        joined = re.compile(rf"[{_LATIN}][^{_LATIN}{MARK}]|[^{_LATIN}{MARK}][{_LATIN}]")
        run = rf"[^{MARK}{loose}]+" if any(map(joined.search, self.ids)) else rf"[{_LATIN}]+|[^{_LATIN}{MARK}{loose}]+"
        self.words = re.compile(rf"{MARK}*(?:{run})|{MARK}+" + (f"|[{loose}]+" if loose else "")).findall
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte_ids)):
            raise ValueError("the model has no pieces for bytes")
        self.bytes_of = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.stable: dict[int, bool] = {}
        self.known = Memory()

    def merged(self, parts: list[str], rank: dict[str, float]) -> list[str]:
        """``parts`` after merging the best pair, of equal ones the left one, again and again."""
        n = len(parts)
        parts, after, ahead = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        heapify(pairs)
        while pairs:
            _, i, a, b = heappop(pairs)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has merged since
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for x, y in ((ahead[i], i), (i, after[i])):
                if x >= 0 and y < n and parts[x] + parts[y] in rank:
                    heappush(pairs, (rank[parts[x] + parts[y]], x, parts[x], parts[y]))
        return [p for p in parts if p]

    def _fits(self, left: int, piece: int) -> bool:
        """Whether merging the characters of a pair (or of a piece alone, after -1) gives it back."""
        name = lambda i: self.texts[i] if i < _UNKNOWN else chr(i - _UNKNOWN)
        pair = [name(piece)] if left < 0 else [name(left), name(piece)]
        if len(self.stable) > MEMORY_PAIRS:
            self.stable.clear()
        found = self.stable[(left + 1) << 22 | piece] = self.merged(list("".join(pair)), self.early) == pair
        return found

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The pieces' ids of each word of a sorted sequence; characters without a piece count from ``_UNKNOWN``."""
        tails, stable, fits = self.tails.get, self.stable.get, self._fits
        last, begins = [-1], [0]  # of the first i characters: the last piece, and where it begins
        before = ""
        for word in words:
            n = min(len(word), len(before))
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :], begins[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                begin = end - 1
                while True:
                    piece = tails(word[begin:end])
                    if piece is None or (piece < 0 and begin == end - 1):
                        if begin < end - 1:
                            raise ValueError(f"no segmentation of {word[:end]!r}")
                        piece = _UNKNOWN + ord(word[begin])
                    if piece >= 0:
                        left = last[begin]
                        good = stable((left + 1) << 22 | piece)
                        if good or (good is None and fits(left, piece)):
                            last.append(piece)
                            begins.append(begin)
                            break
                    begin -= 1
                    if begin < 0:
                        raise ValueError(f"no segmentation of {word[:end]!r}")
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at = begins[at]
            yield word, out[::-1]
            before = word

    def best_sums(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """As ``segment``, by the best sum of scores; of equal sums the one whose last piece is longest."""
        tails, scores, unknown = self.tails.get, self.scores, self.unknown_score
        last, begins, best = [-1], [0], [np.float32(0)]  # and the best sum of the first i characters
        before = ""
        for word in words:
            n = min(len(word), len(before))
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :], begins[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                begin, top, at = end - 1, None, (0, 0)
                alone = tails(word[begin:end])
                if alone is None or alone < 0:  # a character that is no piece by itself
                    top, at = best[begin] + unknown, (_UNKNOWN + ord(word[begin]), begin)
                while begin >= 0:
                    piece = tails(word[begin:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        total = best[begin] + scores[piece]
                        if top is None or total >= top:
                            top, at = total, (piece, begin)
                    begin -= 1
                last.append(at[0])
                begins.append(at[1])
                best.append(top)
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at = begins[at]
            yield word, out[::-1]
            before = word

    def _finished(self, word: str, parts: list[int]) -> list[int]:
        """``parts`` after the merges into pieces of the shared rank."""
        names = [self.texts[p] if p < _UNKNOWN else chr(p - _UNKNOWN) for p in parts]
        if not any(a + b in self.late for a, b in zip(names, names[1:], strict=False)):
            return parts
        return [self.ids.get(p, _UNKNOWN + ord(p[0])) for p in self.merged(names, self.rank)]

    def learn(self, words: set[str]) -> None:
        bpe = self.kind == "bpe"
        for word, parts in (self.segment if bpe else self.best_sums)(sorted(words)):
            if bpe and self.late and len(parts) > 1 and not self.late_letters.isdisjoint(word[1:]):
                parts = self._finished(word, parts)
            if max(parts) >= _UNKNOWN:
                parts = [i for p in parts for i in ([p] if p < _UNKNOWN else [self.byte_ids[b] for b in chr(p - _UNKNOWN).encode()])]
            self.known[word] = array("I", parts).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(self.known.unknown(set().union(*cut)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


ENCODED = "id long, ids array<int>"
DIGESTS = "id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for lo in range(0, len(batch), CHUNK_TEXTS):
            yield batch.column(0).slice(lo, CHUNK_TEXTS), [t or "" for t in batch.column(1).slice(lo, CHUNK_TEXTS).to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, ids."""
    ship(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for ids, texts in _chunks(batches):
            coded = [np.frombuffer(b, dtype="<i4") for b in model.encode(texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, coded)]), pa.int32()), pa.array(np.concatenate(coded)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids) to (id, text)."""
    ship(coded.sparkSession)
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [model.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return coded.select("id", "ids").mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, number and crc of its ids, crc of what they decode to, and whether that is the text."""
    ship(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for ids, texts in _chunks(batches):
            coded = model.encode(texts)
            back = [model.decode(b) for b in coded]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(b) // 4 for b in coded], pa.int64()),
                    pa.array([zlib.crc32(b) for b in coded], pa.int64()),
                    pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                names=[f.split()[0] for f in DIGESTS.split(", ")],
            )

    return _rows(docs, id_col, text_col).mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
