from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np

from proofset.llm import packing as op


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        placed = {}
        for length, rank, n, first, each, offset in op.best_fit_decreasing(counts, 64):
            for k in range(n):
                placed[length, rank + k] = (first + k // each, offset + k % each * length)
        assert sorted(placed) == sorted((n, k) for n in counts for k in range(counts[n]))
        used = {}
        for (length, _), (sequence, offset) in placed.items():
            used.setdefault(sequence, []).append((offset, length))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        assert sorted(64 - sum(n for _, n in parts) for parts in used.values()) == plain_best_fit(lengths, 64)


def test_segment_tree():
    tree, open_bins, rng = op.Capacities(100), [], random.Random(1)
    for _ in range(2000):
        if open_bins and rng.random() < 0.5:
            c = open_bins.pop(rng.randrange(len(open_bins)))
            tree.add(c, -1)
        else:
            open_bins.append(rng.randrange(1, 101))
            tree.add(open_bins[-1], 1)
        n = rng.randrange(1, 101)
        assert tree.tightest(n) == min((c for c in open_bins if c >= n), default=None)


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.vocabulary_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    encode = op.encoder(op.vocabulary_path()).encode
    rng = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "'s", "'", "1", "23", "!", "\t", "<|endoftext|>", " ", "—", "ﬁ", "\x1c", "́", "²"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(2000)] + ["x" * 5000, "", " ", "a\n\n b "]
    assert all(encode(t).tolist() == ids_of(t) for t in texts)


def test_words_are_the_library_s():
    split = library().pre_tokenizer.pre_tokenize_str
    whole = op.encoder(op.vocabulary_path()).whole
    for c in [*range(0xD800), *range(0xE000, 0x110000, 7)]:
        text = f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!{chr(c)} b"
        assert whole.search(text) or [m.span() for m in op.pre_tokens().finditer(text)] == [at for _, at in split(text)], hex(c)


def test_new_words_of_many_texts_are_learned_together(monkeypatch, prose):
    own = op.Encoder(op.vocabulary_path())
    calls, learn = [], own.learn
    monkeypatch.setattr(own, "learn", lambda words: calls.append(len(words)) or learn(words))
    texts = [prose(i, 300) + " é naïve 日本 ﬁn ' 's 12 x\u0301 <|endoftext|>"[: 1 + i % 40] for i in range(50)] + ["", " ", "y" * 99]
    assert [x.tolist() for x in own.encode_all(texts)] == [ids_of(t) for t in texts] and len(calls) == 2  # short words, long ones
    words = [" one", " deux", " Straße", " 日本", "one", " 1", "'s", " \n", " a1"]
    ids, starts, lengths = own.learn(words)
    assert [ids[a : a + n].tolist() for a, n in zip(starts, lengths, strict=True)] == [ids_of(w) for w in words]
    singly = []
    encode = own.tokenizer.encode_batch_fast
    monkeypatch.setattr(own, "tokenizer", type("Counting", (), {"encode_batch_fast": lambda _, x, **k: singly.append(len(x)) or encode(x, **k)})())
    assert len(own.learn([f" {w}" for w in prose(7, 500).split()])[1]) == 500 and singly == [1, 0]


def test_runs_of_texts(monkeypatch, prose):
    monkeypatch.setattr(op, "RUN_LETTERS", 500)
    monkeypatch.setattr(op, "KNOWN_WORDS", 100)
    own = op.Encoder(op.vocabulary_path())
    texts = [prose(i, n) for i, n in enumerate([0, 10, 400, 1, 30, 30, 30, 30, 500, 0])] + ["x" * 400, "x" * 400, "x" * 400]
    assert [x.tolist() for x in own.encode_all(texts)] == [ids_of(t) for t in texts] and list(own.encode_all([])) == []


def test_memory_of_words_is_bounded(monkeypatch, prose):
    monkeypatch.setattr(op, "KNOWN_WORDS", 50)
    own = op.Encoder(op.vocabulary_path())
    for i in range(60):
        text = prose(i, 40) + " " + "x" * i + f" {i}" * 3
        assert own.encode(text).tolist() == ids_of(text) and len(own.known) <= 50 + 200
        assert max(map(len, own.known)) <= op.KNOWN_LETTERS


def test_pieces_and_places(spark, frame, odd_rows, prose):
    rows = [*odd_rows, *((100 + i, prose(i, 5 * i)) for i in range(200))]
    got = op.pack(frame(rows).repartition(5)).collect()
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append([*ids_of(text), op.END_ID])
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        ids = want[i][0]
        if i is None:
            continue
        assert sum(p.length for p in parts) == sum(map(len, want[i]))
        for p in parts:
            part = np.asarray(ids[p.start : p.start + p.length], dtype="<u4")
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
            assert p.length == op.CAPACITY or p.piece == 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= op.CAPACITY
    lengths = [r.length for r in got]
    assert len(sequences) == len(plain_best_fit(lengths, op.CAPACITY))


def test_empty_table(spark, frame):
    assert op.pack(frame([])).count() == 0


def test_words_are_cut_as_arrays():
    own, rng = op.encoder(op.vocabulary_path()), random.Random(3)
    alphabet = ["a", "s", "l", "ll", "ve", "re", "d", "the", " ", " ", "  ", "\n", "\t", "é", "漢", "😀", "'", "'s", "1", "23", "!", "\xa0", "　", "\x1c", "́", "²", "<|endoftext|>"]
    for _ in range(1500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(7))]
        words, which, bounds, whole = own.words(texts)
        assert whole.tolist() == [bool(own.whole.search(t)) for t in texts]
        got = [[words[i] for i in which[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [[] if own.whole.search(t) else op.pre_tokens().findall(t) for t in texts], texts


def test_a_run_looks_each_distinct_word_up_once():
    own, asked = op.Encoder(op.vocabulary_path()), []

    class Asked(dict):
        def get(self, word, *default):
            asked.append(word)
            return super().get(word, *default)

    own.known = Asked()
    texts = ["to be or not to be" * 30, " to be", "to do, to be"] * 40
    assert [x.tolist() for x in own.run(texts)] == [ids_of(t) for t in texts]
    assert asked and len(asked) == len(set(asked))


def test_kinds_are_those_of_the_patterns():
    import re

    for c in [*range(0xD800), *range(0xE000, 0x110000, 5)]:
        kind = op.kinds()[c]
        assert bool(kind & op.UNSURE) == bool(re.match(f"[{op.UNSETTLED}]", chr(c)))
        assert (kind & 3 == op.BLANK) == bool(re.match(f"[{op.SPACE}]", chr(c)))
