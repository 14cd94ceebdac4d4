"""Language of documents by a linear-chain conditional random field over words.

Each word is described by its affixes, character n-grams and, if the training
sample has it, its lexicon entry; the field adds learned transitions between the
labels of neighbouring words. It is trained on code-switched sequences, made of
runs of words from documents of different languages, by the exact gradient from
forward-backward. A document's label is the one with the largest mean posterior
over its words, which is also the score.

Words are unbroken letters; marks, format characters and apostrophes, which stand within
words, are taken out first. More than ``LETTERS`` letters in a row are cut into
even pieces. So every letter counts, by one rule at any length.

What stands between spaces is looked up in a bounded memory of emission scores;
forward-backward runs over all documents of a chunk at once, step by step, with
the documents that are still running.

The fit sees at most ``SAMPLE_DOCS`` documents, drawn by a hash and shared evenly by
all languages (one document each where there are more languages than that). Of a text
over ``SAMPLE_BYTES`` bytes it sees a window at a drawn place. The lexicon has each word
that more than two documents of the sample have. Prediction reads every whole text.

Defined results
    null text, no letter   ``und`` with score 0
    very long text         read whole; one word is one step, memory grows with the text
    null lang              does not train
    no labelled rows       every text is ``und`` with score 0
    null id                counts as empty text in the fold's remainder
    ties                   the first label in alphabetical order
    repeated rows          equal texts, equal results (scores are rounded to four places,
                           as sums in single precision depend on the batch in the last digits)
    empty table            empty result
    extra columns          are not read, so their names cannot clash
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofset.llm.common import documents, id_remainder, mix64, ship

FOLDS, HELD_OUT = 5, 0
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_BYTES = 2400, 20_000
UNKNOWN = "und"

#: Letters of a word at most; more in a row are several words.
LETTERS = 20
TABLE = 1 << 16
SEQUENCE, STEPS, BATCH, RATE, DECAY = 48, 80, 256, 0.2, 1e-4
#: Characters of text that are labelled at a time, and words remembered.
CHUNK_CHARS, MEMORY_WORDS = 4 << 20, 400_000

#: Categories of characters that stand within words, and others that do.
WITHIN, APOSTROPHES = ("Mn", "Mc", "Me", "Cf"), "'\u2019"

_U = np.uint64
_SALT = mix64(np.arange(1, 9, dtype=_U) * _U(0x9E3779B97F4A7C15))


def pieces(run: str) -> list[str]:
    """The words of a run without spaces, of at most ``LETTERS`` letters each."""
    low = run.lower()
    if low.isalpha():
        parts = [low]
    else:
        parts = "".join(c if c.isalpha() else "" if c in APOSTROPHES or unicodedata.category(c) in WITHIN else " " for c in low).split()
    out = []
    for part in parts:
        n = -(-len(part) // LETTERS)
        out += [part[i * len(part) // n : (i + 1) * len(part) // n] for i in range(n)]
    return out


def runs(text: str) -> list[str]:
    """What stands between spaces; where it is long, its words, so that no long run is remembered."""
    found = text.split()
    if max(map(len, found), default=0) <= LETTERS:
        return found
    return [p for r in found for p in (pieces(r) if len(r) > LETTERS else (r,))]


def feature_rows(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Rows of the weight table for each word; row ``TABLE`` stands for nothing."""
    n = len(words)
    length = np.array([len(w) for w in words])
    codes = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS).astype(_U)
    marked = np.zeros((n, LETTERS + 2), dtype=_U)
    marked[:, 0] = 1
    marked[:, 1:-1] = codes
    marked[np.arange(n), length + 1] = 2
    out = []

    def add(hashed: np.ndarray, salt: int, there: np.ndarray) -> None:
        row = (mix64(hashed + _SALT[salt]) & _U(TABLE - 1)).astype(np.int64)
        out.append(np.where(there, row, TABLE))

    for size in (2, 3):
        for at in range(LETTERS + 3 - size):
            gram = marked[:, at].copy()
            for k in range(1, size):
                gram = gram * _U(0x100000001B3) + marked[:, at + k]
            add(gram, size, at + size <= length + 2)
    for size in (1, 2, 3):
        prefix, suffix = codes[:, 0].copy(), codes[np.arange(n), np.maximum(length - 1, 0)].copy()
        for k in range(1, size):
            prefix = prefix * _U(0x100000001B3) + codes[:, k]
            suffix = suffix * _U(0x100000001B3) + codes[np.arange(n), np.maximum(length - 1 - k, 0)]
        add(prefix, 3 + size, length >= size)
        add(suffix + _U(size), 7, length >= size)
    entry = [lexicon.get(w, -1) for w in words]
    out.append(np.where(np.array(entry) >= 0, TABLE + 1 + np.array(entry), TABLE))
    return np.stack(out, axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words of sequences and the transitions' expected counts.

    ``scores`` has the words of all sequences, one after another; ``lengths`` falls.
    """
    k = scores.shape[1]
    move = np.exp(transition)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    heads = np.cumsum(lengths) - lengths
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    alpha = np.empty_like(emit)
    before = np.full((len(lengths), k), 1.0 / k, dtype=emit.dtype)
    for t, m in enumerate(running):
        at = heads[:m] + t
        now = before[:m] @ move if t else before[:m]
        now = now * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
        before = now
    posterior = np.empty_like(emit)
    expected = np.zeros((k, k))
    beta = np.ones((len(lengths), k), dtype=emit.dtype)
    for t in range(len(running) - 1, -1, -1):
        m = running[t]
        at = heads[:m] + t
        if t + 1 < len(running):
            go = running[t + 1]
            ahead = emit[at[:go] + 1] * beta[:go]
            back = ahead @ move.T
            before = alpha[at[:go]]
            before = before / (before * back).sum(axis=1, keepdims=True)
            expected += move * (before.T @ ahead)  # never labels x labels for each sequence
            beta[:go] = back / back.sum(axis=1, keepdims=True)
        both = alpha[at] * beta[:m]
        posterior[at] = both / both.sum(axis=1, keepdims=True)
    return posterior, expected


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray
    lexicon: dict[str, int]
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    several: list[list[int]] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None, "several": []}

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for lo in range(0, len(words), 8192):
            rows = feature_rows(words[lo : lo + 8192], self.lexicon)
            for column in rows.T:
                out[lo : lo + 8192] += self.weights[column]
        return out

    def learn(self, raw: set[str]) -> None:
        """Remember the emission rows of runs: of one word its row, of none -1, of several
        -2 less their place in ``several``."""
        if self.table is None or len(self.known) + len(raw) > MEMORY_WORDS:
            self.known, self.table, self.several = {}, np.zeros((0, len(self.labels)), dtype=np.float32), []
        forms = {r: pieces(r) for r in raw}
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for f in forms.values() for w in f), start=len(self.table))}
        if distinct:
            self.table = np.concatenate((self.table, self.emissions(list(distinct))))
        for r, words in forms.items():
            if len(words) > 1:
                self.known[r] = -2 - len(self.several)
                self.several.append([distinct[w] for w in words])
            else:
                self.known[r] = distinct[words[0]] if words else -1

    def words(self, tokens: list[str]) -> np.ndarray:
        """The emission rows of the words of remembered runs."""
        rows = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(rows) and rows.min() < -1:
            rows = np.fromiter((w for r in rows.tolist() for w in (self.several[-2 - r] if r < -1 else (r,))), dtype=np.int64)
        return rows[rows >= 0]

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        tokens = [runs(t) for t in texts]
        new = set().union(*tokens).difference(self.known)
        if new:
            self.learn(set().union(*tokens) if len(self.known) + len(new) > MEMORY_WORDS else new)
        rows = [self.words(t) for t in tokens]
        out = [(UNKNOWN, 0.0)] * len(texts)
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: -len(rows[i]))
        if order:
            lengths = np.array([len(rows[i]) for i in order])
            posterior, _ = forward_backward(self.table[np.concatenate([rows[i] for i in order])], lengths, self.transition)
            means = np.add.reduceat(posterior, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]
            for i, m in zip(order, means, strict=True):
                best = int(m.argmax())
                out[i] = (self.labels[best], round(min(1.0, float(m[best])), 4))
        return out


def train(sample: list[tuple[str, str]], seed: int = 5) -> Field | None:
    """Fit on (text, lang) rows."""
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    k = len(labels)
    docs = [([w for r in runs(text) for w in pieces(r)], labels.index(lang)) for text, lang in dict.fromkeys(sample)]
    docs = [d for d in docs if d[0]]
    seen: dict[str, int] = {}
    for words, _ in docs:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 2))}
    vocabulary = {w: i for i, w in enumerate(sorted(seen))}
    rows = feature_rows(list(vocabulary), lexicon) if vocabulary else np.zeros((0, 1), dtype=np.int64)
    weights = np.zeros((TABLE + 1 + len(lexicon), k))
    transition = np.zeros((k, k))
    moved, moved_t = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    coded = [(np.array([vocabulary[w] for w in words]), y) for words, y in docs]
    by_label = [[d for d in coded if d[1] == y] for y in range(k)]
    by_label = [d for d in by_label if d]
    for _ in range(STEPS if coded else 0):
        words, gold = np.empty((BATCH, SEQUENCE), dtype=np.int64), np.empty((BATCH, SEQUENCE), dtype=np.int64)
        for b in range(BATCH):
            at = 0
            while at < SEQUENCE:  # a run of words from a document of any language
                of = by_label[rng.integers(len(by_label))]
                run, y = of[rng.integers(len(of))]
                n = min(int(rng.integers(4, SEQUENCE)), SEQUENCE - at, len(run))
                begin = int(rng.integers(len(run) - n + 1))
                words[b, at : at + n], gold[b, at : at + n] = run[begin : begin + n], y
                at += n
        used, inverse = np.unique(words, return_inverse=True)
        inverse = inverse.ravel()
        emitted = weights[rows[used]].sum(axis=1)
        posterior, expected = forward_backward(emitted[inverse], np.full(BATCH, SEQUENCE), transition)
        posterior[np.arange(len(inverse)), gold.ravel()] -= 1
        slope = np.zeros((len(used), k))
        np.add.at(slope, inverse, posterior)
        step_rows = rows[used].ravel()
        g = np.stack([np.bincount(step_rows, weights=np.repeat(slope[:, y], rows.shape[1]), minlength=len(weights)) for y in range(k)], axis=1)
        g = g / BATCH + DECAY * weights
        g[TABLE] = 0
        moved += g**2
        weights -= RATE * g / np.sqrt(moved)
        had = np.zeros((k, k))
        np.add.at(had, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g = (expected - had) / BATCH + DECAY * transition
        moved_t += g**2
        transition -= RATE * g / np.sqrt(moved_t)
    return Field(labels, weights.astype(np.float32), transition.astype(np.float32), lexicon)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Labelled rows that aren't held out, by the bounds above."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").filter(id_remainder(F.col("id"), FOLDS) != HELD_OUT)
    rows = rows.filter(F.octet_length("text") > 0)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return []
    each = max(1, SAMPLE_DOCS // len(counts))
    # A few more than asked for are drawn, so that hardly any language has fewer; the rank is exact.
    ample = each + 6 * each**0.5 + 20
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, ample / r.n))))
    window = SAMPLE_BYTES // 4  # characters have up to four bytes
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    seen = F.when(F.octet_length("text") > SAMPLE_BYTES, F.substring("text", begin, F.lit(window))).otherwise(F.col("text"))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")]).select(seen.alias("text"), "lang", "draw")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    found = drawn.withColumn("rank", rank).filter(F.col("rank") <= each).select("text", "lang").collect()
    return sorted((r.text, r.lang) for r in found)


def predict(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column(1).cast(pa.large_string()).fill_null("").to_pandas().str.len().to_numpy(dtype=np.int64))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK_CHARS, side="right")))
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                found = model.label(texts) if model else [(UNKNOWN, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["id", "lang_pred", "score"],
                )
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    model = train(training_sample(docs, id_col, text_col, lang_col))
    found = predict(docs, model, id_col, text_col)
    return found.select("id", (id_remainder(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
