from __future__ import annotations

import zlib

import numpy as np
import pytest

from proofset.llm import quality as op
from proofset.llm.common import documents, table


def stats_of(texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    return op.statistics(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Hello World!\nA line of text.\nA line of text.\n", "", "ABC!!", "  ", "a | b | c", "é" * 9]
    together = stats_of(texts)
    for row, text in zip(together, texts, strict=True):
        assert row == pytest.approx(stats_of([text])[0])
    assert together.shape == (6, op.D) and np.isfinite(together).all()
    assert together[0][op.NAMES.index("again")] > 0 and together[4][op.NAMES.index("again")] == 0


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (300, op.D)), 1: rng.normal(1, 2, (500, op.D))}
    model = op.fit_moments({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    every = np.concatenate(list(x.values()))
    centre, scale = every.mean(axis=0), every.std(axis=0)
    cov = {k: np.cov(((v - centre) / scale).T, bias=True) for k, v in x.items()}
    pooled = (300 * cov[0] + 500 * cov[1]) / 800
    point = every[:50]
    logs = []
    for k, share in ((0, 300 / 800), (1, 500 / 800)):
        s = (1 - op.POOLED - op.IDENTITY) * cov[k] + op.POOLED * pooled + op.IDENTITY * np.eye(op.D)
        d = (point - centre) / scale - ((x[k].mean(axis=0) - centre) / scale)
        logs.append(np.log(share) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert model.scores(point) == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0]) / op.TEMPERATURE)))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    got = op.query(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95


def test_only_training_labels_count(spark, frame, prose):
    docs = frame([(i, prose(i, 40) if i % 2 else prose(i, 40).upper() + "!!") for i in range(200)])
    rows = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in rows]
    a, b = ({r.id: r.score for r in op.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (rows, turned))
    assert a == b


def test_odd_rows(spark, frame, odd_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = op.classify(frame(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = op.classify(frame(odd_rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert op.classify(frame([]), labels).count() == 0


def test_filter_keeps_what_scores_well(spark):
    d = "/root/testdata/sf0.001"
    docs = documents(spark, d)
    good = {r.doc_id for r in op.query(spark, d).collect() if r.predicted}
    out = op.keep_good(docs, table(spark, d, "labels"))
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == good


def plain_statistics(text: str) -> list[float]:
    """The statistics as written in words, one byte after the other."""
    data = text.encode()
    n, space, digits = max(len(data), 1), b" \t\n\x0b\x0c\r", b"0123456789"
    share = lambda test: sum(map(test, data)) / n
    words, lines = data.split(), data.split(b"\n")
    again, seen = 0, set()
    for i, line in enumerate(lines):
        whole = len(line) + (i < len(lines) - 1)
        again += whole if whole > 8 and line in seen else 0
        seen.add(line)
    same = sum(x == y and y not in space for x, y in zip(data, data[1:], strict=False))
    spaces = sum(x in space and y in space for x, y in zip(data, data[1:], strict=False))
    symbols = b"#$%&*<=>@\\^_`{}~+[]/"
    solid = sum(x not in space for x in data)
    n_words = max(len(words), 1)
    shares = [
        share(lambda x: 65 <= x <= 90), share(lambda x: 97 <= x <= 122), share(lambda x: x in digits), share(lambda x: x >= 128), share(lambda x: x in b".?"),
        share(lambda x: x in b"!"), share(lambda x: x in b",;:"), share(lambda x: x in b"|"), share(lambda x: x in symbols),
    ]
    capitals = sum(65 <= w[0] <= 90 for w in words)
    logs = [len(data), solid / n_words, len(data) / len(lines), len(lines)]
    return [*np.sqrt(shares), *np.log1p(logs), *np.sqrt([again / n, capitals / n_words, same / n, spaces / n])]


def test_statistics_against_brute_force(prose):
    line = "The Same Line, again.\n"
    texts = ["", " ", "A", "Hello World!! 12 | {x}", line * 4 + "end", line + "between\n" + line, "x\n" * 9, "É é\t\tß...", "a  b\n\n\nC", prose(3, 400), "no end\n" + line[:-1] + "\n" + line[:-1], "~`@#$%^&*()_+-=[]{}\\|;:'\",./<>?"]
    for row, text in zip(stats_of(texts), texts, strict=True):
        assert dict(zip(op.NAMES, row, strict=True)) == pytest.approx(dict(zip(op.NAMES, plain_statistics(text), strict=True))), text
