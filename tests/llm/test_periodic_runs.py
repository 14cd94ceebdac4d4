"""Runs against comparing all words for each period, and the query against its definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from proofset.llm import periodic_runs as pr


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((b, length, q) for (b, length), q in out.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if n and doc_id is not None and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for b, length, q in runs for i in range(b + q, b + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{b},{length},{q}\n" for b, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sums = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sums)


def periodic_texts(seed, count):
    """Texts made of repeated pieces over few words, so that runs touch, nest and overlap."""
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(1, 6)):
            piece = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 9))]
            words += piece * rng.randrange(1, 8) + piece[: rng.randrange(len(piece) + 1)]
        yield rng.choice([" ", "\n", " \t "]).join(words)


def by_number(texts):
    numbers = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]
    return np.array([w for t in words for w in t], dtype=np.int64), np.cumsum([0, *map(len, words)])


def test_runs_equal_plain_version(monkeypatch):
    texts = [*periodic_texts(1, 400), "", "a", "a " * 5, "a " * 6, "a b " * 400, "a " * 3000]
    want = [plain_runs(t.split()) for t in texts]
    assert pr.runs_of(*by_number(texts)) == want
    monkeypatch.setattr(pr, "PAIRS", 7)
    assert pr.runs_of(*by_number(texts[:60])) == want[:60]
    assert sum(map(len, want)) > 500 and max(q for f in want for _, _, q in f) > 6


def test_colliding_hashes_change_nothing(monkeypatch):
    """All random values equal: every two stretches of one length have the same hash."""
    texts = list(periodic_texts(2, 150))
    monkeypatch.setattr(pr, "mix64", lambda x: np.ones_like(x))
    monkeypatch.setattr(pr, "_BASE", 1)
    assert pr.runs_of(*by_number(texts)) == [plain_runs(t.split()) for t in texts]


def test_thue_morse_words():
    """Sums of powers modulo 2^64 cannot tell these apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
    flip = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(word + flip), " ".join(word[:2048] + flip[:2048] + word[:2048] * 2 + word[:100]), " ".join(word[:1024] * 5)]
    got = pr.runs_of(*by_number(texts))
    words, ends = by_number(texts)
    for k, found in enumerate(got):
        exact = {}
        for b, e, q in pr._exact(words[ends[k] : ends[k + 1]]):
            exact.setdefault((b, e), q)
        assert found == sorted((b, e - b, q) for (b, e), q in exact.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_query_equals_plain_version(spark, frame, prose, odd_rows, tmp_path):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate([*periodic_texts(5, 60), *(prose(k, rng.randrange(0, 300)) for k in range(60))], 100)]
    rows += [r for r in odd_rows if len(r[1] or "") < 250_000 or len(r[1].split()) == 1]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((plain_row(*r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert rows_of(pr.query(spark, str(tmp_path))) == want
    assert sum(r[1] > 0 for r in want) > 40


def test_long_text_and_empty_table(spark, frame, prose):
    """A text of many words with a long period is one record, and whole."""
    base = prose(7, 30_000)
    row = pr.periodic_runs(frame([(1, f"{base} {base} {base} {base} tail")])).first()
    assert (1, row.n_words) == (row.id, 120_001) and [tuple(r) for r in row.runs] == [(0, 120_000, 30_000)]
    assert row.collapsed.split() == [*base.split(), "tail"]
    assert pr.periodic_runs(frame([])).count() == 0
