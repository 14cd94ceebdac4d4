from __future__ import annotations

import random
import re

import numpy as np
import pytest

from proofset.llm import near_dedup as op
from proofset.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def found(df):
    return sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark, frame, prose):
    rows = [(i, prose(i, 40 + i)) for i in range(30)]
    for base in range(4):
        rows += [(100 + 40 * base + k, edited(prose(base, 120), k, k % 9)) for k in range(40)]
    rows += [(500, prose(3, 43).upper()), (501, "a b c"), (502, "A  b\nc"), (503, "a b c d"), (504, "a b c d e f g h"), (505, "a b c d e f g")]
    assert found(op.near_duplicates(frame(rows).repartition(5))) == brute(rows)


def test_odd_rows(spark, frame, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    want = {}
    for i, t in rows:
        same = [j for j, u in rows if shingles(u) == shingles(t)] if shingles(t) else [i]
        want[i] = (len(shingles(t)), min(same))
    got = op.near_duplicates(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all((r.n_shingles, r.component_id) == want[r.id] for r in got if r.id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.id is None)


def test_empty_table(spark, frame):
    assert op.near_duplicates(frame([])).count() == 0


def test_hot_group_of_near_copies(spark, frame, prose):
    """A star's centre does not confirm everyone; the blocks find the rest."""
    rows = [(k, edited(prose(7, 100), k, 1 + k % 5)) for k in range(300)]
    assert found(op.near_duplicates(frame(rows).repartition(6))) == brute(rows)


def test_word_hashes_do_not_depend_on_neighbours():
    def of(texts):
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        return [s.tolist() for s in op.shingle_sets(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))]

    texts = ["a b c d e f", "", "  Lead and  trail \n", "x", "ünï cödé wörds ärê fïne höre"]
    assert of(texts) == [of([t])[0] for t in texts]
    assert of(["A B C D E F"]) == of([" a\tb c d\ne f "])


@pytest.mark.parametrize("n", [1, 2, 5, 40, 400])
def test_bins_estimate_similarity(n):
    rng = np.random.default_rng(n)
    same = []
    for _ in range(60):
        pool = np.sort(rng.integers(0, 2**63, size=2 * n, dtype=np.uint64))
        same.append((op.densified(pool) == op.densified(pool)).all())
    assert all(same)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 101), (200, 200)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_keeps_one_each(spark, frame, prose):
    docs = frame([(1, prose(1, 80)), (2, edited(prose(1, 80), 1, 1)), (3, prose(2, 80)), (4, "")])
    out = op.drop_near_copies(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3, 4}


def test_drop_decides_by_row(spark, frame, prose):
    """One id on two texts, near copies without an id, repeated rows, groups without any id."""
    base = prose(1, 90)
    rows = [(3, base), (5, edited(base, 1, 1)), (5, prose(2, 90)), (None, edited(base, 2, 1)), (None, prose(3, 90)), (None, prose(3, 90)), (8, prose(4, 90)), (8, prose(4, 90)), (None, ""), (7, edited(prose(2, 90), 5, 1))]
    got = sorted(((r.id, r.component_id, r.kept) for r in op.near_duplicates(frame(rows).repartition(3)).collect()), key=str)
    want = [(3, 3, True), (5, 3, False), (5, 5, True), (None, 3, False), (None, None, True), (None, None, True), (8, 8, True), (8, 8, True), (None, None, True), (7, 5, False)]
    assert got == sorted(want, key=str)
    out = op.drop_near_copies(frame(rows).repartition(3))
    stay = {r for r, w in zip(rows, want, strict=True) if w[2]}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(stay, key=str)


def plain_drop(rows):
    """(smallest id or none, texts that may stay) for each component of rows; wordless rows by id and text."""
    parts = []
    for i, t in rows:
        s, joined, rest = shingles(t), [(i, t or "")], []
        for part in parts:
            near = any(s and shingles(u) and 100 * len(s & shingles(u)) >= 75 * len(s | shingles(u)) for _, u in part)
            same = not s and (i, t or "") in part
            (joined.extend(part) if near or same else rest.append(part))
        parts = [*rest, joined]
    out = []
    for part in parts:
        least = min((i for i, _ in part if i is not None), default=None)
        out.append((least, {t for i, t in part if i == least}))
    return out


def test_drop_leaves_one_row(spark, frame, prose):
    """Repeated rows, near copies under one id, under none, and wordless rows."""
    base = prose(11, 90)
    rows = [(3, base), (3, base), (7, base), (3, edited(base, 1, 1)), (None, prose(12, 90)), (None, edited(prose(12, 90), 2, 1)), (None, prose(12, 90))]
    rows += [(4, ""), (4, None), (5, " "), (None, ""), (None, None), (9, prose(13, 90)), (9, prose(14, 90)), (9, "one two"), (10, "ONE two")]
    got = [(r.doc_id, r.text or "") for r in op.drop_near_copies(frame(rows).repartition(4)).collect()]
    want = plain_drop(rows)
    assert len(got) == len(want)
    for least, texts in want:
        assert sum(i == least and t in texts for i, t in got) == 1


def test_hot_centre_is_dealt_to_a_grid(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op, "GRID", 2)
    rows = [(k, edited(prose(7, 100), k, 1 + k % 5)) for k in range(120)]
    assert found(op.near_duplicates(frame(rows).repartition(6))) == brute(rows)
    members = spark.createDataFrame([(c, i, i, i) for c, n in ((1, 60), (2, 3)) for i in range(1, n)], "centre long, id long, component long, n long")
    sets = spark.createDataFrame([(i, list(range(i))) for i in range(1, 60)], "id long, set array<long>")
    pairs = [(x["id"], y["id"]) for r in op._block_pairs(members.filter("id % 2 = 0"), members, sets).collect() for x in r.xs for y in r.ys]
    assert len(pairs) == len(set(pairs)) + 2 and {(a, b) for a in range(2, 60, 2) for b in range(1, 60)} == set(pairs)
