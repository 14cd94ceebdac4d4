from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from proofset.llm import lm_score as op


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, order):
    docs = [words_of(t) for _, t in rows]
    grams = lambda d: Counter(tuple(d[i - k : i + 1]) for i in range(len(d)) for k in range(min(order, i + 1)))
    total, every = Counter(), sum(map(len, docs))
    for d in docs:
        total.update(grams(d))
    out = []
    for (i, _), d in zip(rows, docs, strict=True):
        own, score = grams(d), 0.0
        c = lambda g: total[g] - own[g]  # noqa: B023, E731
        for t in range(len(d)):
            k, back = min(order, t + 1), 0.0
            while k > 1 and not c(tuple(d[t - k + 1 : t + 1])):
                k, back = k - 1, back + math.log(op.BACKOFF)
            gram = tuple(d[t - k + 1 : t + 1])
            score += back + (math.log(c(gram) / c(gram[:-1])) if k > 1 else math.log(max(c(gram), 0.5) / max(every - len(d), 1)))
        out.append((i, len(d), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, frame, prose, monkeypatch, order):
    monkeypatch.setattr(op, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(op, "BUCKET_BYTES", 2000)
    rows = [(i, prose(i % 25, 20 + 3 * i, "ae")) for i in range(60)] + [(90, None), (91, ""), (92, "One"), (93, "one TWO one two")]
    got = sorted(((r.id, r.n_words, r.log_score) for r in op.lm_scores(frame(rows).repartition(3), order=order).collect()), key=str)
    want = brute(rows, order)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_odd_rows(spark, frame, odd_rows):
    got = op.lm_scores(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r.score) for r in got)
    assert {(r.n_words, r.score) for r in got if r.id in (1, 2, 3)} == {(0, 0.0)}
    assert op.lm_scores(frame([])).count() == 0


def test_copies_score_higher(spark, frame, prose):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50, "ouy"))]
    got = {r.id: r.score for r in op.lm_scores(frame(rows)).collect()}
    assert got[1] == got[2] > got[3]


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100, 100_000):
        values = np.unique(rng.integers(0, 2**64, size=n, dtype=np.uint64))
        assert (op.unpacked(memoryview(op.packed(values))) == values).all()
    for top in (1, 255, 256, 70_000, 2**33):
        values = rng.integers(0, top + 1, size=50)
        assert (op.widened(memoryview(op.narrow(values))) == values).all()


def test_query_hears_usual_bigrams_in_an_unusual_order(frame):
    """Both probes are made of equally frequent bigrams; only one has a trigram that occurs elsewhere."""
    rows = [(i, "a b c" if i % 2 else "x b y") for i in range(100)] + [(200, "a b c"), (201, "x b c")]
    got = {r[0]: r.score for r in op.lm_scores(frame(rows)).collect()}
    assert got[200] > got[201]


def test_blocks_go_across_batches(spark, frame, prose):
    """Batches are small for the workers' memory; blocks, on which the number of rows hangs, are not."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        got = op.blocks(frame([(i, prose(i, 50)) for i in range(40)]).coalesce(1), "doc_id", "text").collect()
    finally:
        spark.conf.set(key, before)
    assert [sorted(r.ids) for r in got] == [list(range(40))]


def kernel_block(prose, texts):
    data = [prose(i, n).encode() for i, n in enumerate(texts)]
    offsets = np.cumsum([0, *map(len, data)])
    return op.words_of(np.frombuffer(b"".join(data), np.uint8), offsets)


def kernel_scores(words, before):
    totals = [op.distinct(e)[1] + 1 for e in op.grams(words, before, 3)]
    return op.block_scores(op.grams(words, before, 3), before, iter(totals), 10 * len(words) + 10)


def test_runs_do_not_change_a_block(prose, monkeypatch):
    words, before = kernel_block(prose, [0, 1, 2, 300, 0, 5, 40, 3, 7, 90, 0])
    whole = kernel_scores(words, before), list(op.grams(words, before, 3))
    for run in (1, 2, 7, 100):
        monkeypatch.setattr(op, "RUN_WORDS", run)
        assert kernel_scores(words, before) == pytest.approx(whole[0], rel=1e-12)
        assert all((a == b).all() for a, b in zip(op.grams(words, before, 3), whole[1], strict=True))


def test_scratch_of_a_block_is_small(prose):
    """It was 170 bytes a word, texts and words included, when all n-grams and counts of a block stood side by side."""
    words, before = kernel_block(prose, [2000] * 300)
    totals = [op.distinct(e)[1] + 1 for e in op.grams(words, before, 3)]
    tracemalloc.start()
    op.block_scores(op.grams(words, before, 3), before, iter(totals), 10 * len(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(words), peak / len(words)
