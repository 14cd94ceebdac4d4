from __future__ import annotations

import zlib

import numpy as np

from proofset.llm import lang_id as op


def letters(run):
    return "".join(c for c in run.lower() if c.isalpha())


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths = np.array([4, 3, 3, 1])
    scores, transition = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    posterior, expected = op.forward_backward(scores, lengths, transition)
    at, total = 0, np.zeros((3, 3))
    for n in lengths:
        paths = list(product(range(3), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[at + t, y] for t, y in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            want = [sum(w for w, p in zip(weight, paths, strict=True) if p[t] == y) for y in range(3)]
            assert np.allclose(posterior[at + t], want)
        for w, p in zip(weight, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                total[a, b] += w
        at += n
    assert np.allclose(expected, total)


def test_features_do_not_depend_on_neighbours():
    words = ["a", "ab", "bonjour", "straße", "x" * 20]
    together = op.feature_rows(words, {"ab": 3})
    assert all((row == op.feature_rows([w], {"ab": 3})[0]).all() for row, w in zip(together, words, strict=True))
    assert together[1][-1] == op.TABLE + 4 and together[0][-1] == op.TABLE


def test_held_out_accuracy(spark):
    from proofset.llm.common import documents

    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in documents(spark, d).collect()}
    got = op.query(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(langs) and sum(held) / len(held) > 0.97


def test_words_of_code_switched_text(prose):
    """Transitions keep runs together: words are labelled by their side of the switch."""
    sample = [(prose(i, 60, "aei"), "one") for i in range(80)] + [(prose(1000 + i, 60, "ouy"), "two") for i in range(80)]
    model = op.train(sample)
    assert (np.diag(model.transition) > model.transition.mean(axis=0)).all()
    words = [w for w in map(letters, (prose(7, 30, "aei") + " " + prose(8, 30, "ouy")).split())]
    posterior, _ = op.forward_backward(model.emissions(words), np.array([60]), model.transition)
    assert (posterior.argmax(axis=1) == [0] * 30 + [1] * 30).mean() > 0.95


def test_odd_rows(spark, frame, odd_rows):
    rows = [(100 + i, "le chat et la souris" if i % 2 else "the cat and the mouse", "fr" if i % 2 else "en") for i in range(40)]
    rows += [(i, t, None) for i, t in odd_rows]
    got = op.identify(frame(rows)).collect()
    assert len(got) == len(rows)
    blank = {r.id: (r.lang_pred, r.score) for r in got if r.id in (1, 2, 3, 7, 9)}
    assert set(blank.values()) == {("und", 0.0)}
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert all(r.lang_pred != "und" for r in got if r.id in (4, 5, 6, 8, 10))
    nothing = op.identify(frame([(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert op.identify(frame([])).count() == 0


def test_memory_is_bounded(monkeypatch, prose):
    model = op.train([("un deux trois", "fr"), ("one two three", "en")])
    whole = model.label([prose(1, 400), prose(2, 400)])
    monkeypatch.setattr(op, "MEMORY_WORDS", 50)
    small = op.train([("un deux trois", "fr"), ("one two three", "en")])
    again = [small.label([prose(i, 400)])[0] for i in (1, 2)]
    assert [a[0] for a in again] == [w[0] for w in whole] and np.allclose([a[1] for a in again], [w[1] for w in whole], atol=2e-4)


def test_every_letter_of_a_long_run_counts(prose):
    assert op.pieces("don't") == ["dont"] and op.pieces("1" * 99) == []
    for run in ("x" * 10_000, "un,deux;" * 500, "ab" * 10 + "c"):
        assert "".join(op.pieces(run)) == letters(run) and max(map(len, op.pieces(run))) <= op.LETTERS
    assert op.pieces("un,deux," * 9) == ["un", "deux"] * 9
    model = op.train([(prose(i, 60, "aei"), "one") for i in range(80)] + [(prose(1000 + i, 60, "ouy"), "two") for i in range(80)])
    few, many = prose(1, 5, "aei"), prose(2, 3000, "ouy")
    assert [f[0] for f in model.label([f"{few} {many.replace(' ', '')}", f"{few} {many.replace(' ', ',')}"])] == ["two", "two"]
    ends = prose(3, 20, "aei").replace(" ", "")
    inner = [ends + prose(4, 2000, v).replace(" ", "") + ends for v in ("aei", "ouy")]
    assert [f[0] for f in model.label(inner)] == ["one", "two"]


def test_runs_split_alike_at_any_length():
    """Punctuation parts words, marks and apostrophes do not, in short runs and long ones."""
    for run, words in (("a,b", ["a", "b"]), ("one-two", ["one", "two"]), ("don't", ["dont"]), ("e\u0301t\u00e9", ["et\u00e9"]), ("x1y", ["x", "y"])):
        for times in (1, 3, 50, 2000):
            assert op.pieces(",".join([run] * times)) == words * times
            assert [w for r in op.runs(",".join([run] * times)) for w in op.pieces(r)] == words * times
    model = op.train([("un deux trois", "fr"), ("one two three", "en")])
    apart, joined = "un deux one two un", "un,deux;one-two.un"
    assert model.label([apart]) == model.label([joined]) == model.label([joined, apart])[1:]
    assert model.label([" ".join([apart] * 40)]) == model.label([";".join([joined] * 40)])


def test_lexicon_has_every_word_of_three_documents():
    sample = [(" ".join(f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(600)) + f" own{chr(97 + k)}", "en") for k in range(3)]
    model = op.train(sample)
    assert len(model.lexicon) == 600 and len(model.weights) == op.TABLE + 1 + 600


def test_every_language_is_in_the_bounded_sample(spark, frame, prose, monkeypatch):
    """More languages than 64, one that has long texts only, and more documents than asked for."""
    rows = [(i, prose(i, 5), f"l{i % 70:02d}") for i in range(1400)]
    rows += [(2000 + i, prose(i, 9_000), "long") for i in range(10)]
    monkeypatch.setattr(op, "SAMPLE_DOCS", 7 * 71)
    found = op.training_sample(frame(rows, clashes=False), "doc_id", "text", "lang")
    taken = {lang: sum(x == lang for _, x in found) for lang in {r[2] for r in rows}}
    assert len(taken) == 71 and all(1 <= n <= 7 for n in taken.values()) and len(found) <= op.SAMPLE_DOCS
    assert all(len(text.encode()) <= op.SAMPLE_BYTES and text.strip() for text, _ in found)
    monkeypatch.setattr(op, "SAMPLE_DOCS", 10)
    assert {lang for _, lang in op.training_sample(frame(rows, clashes=False), "doc_id", "text", "lang")} == set(taken)
