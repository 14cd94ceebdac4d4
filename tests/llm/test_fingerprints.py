"""Fingerprints against a plain version, and estimates against exact similarities."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from proofset.llm import fingerprints as fp

SEED = 42


def h64(*values):
    """Spark's xxhash64 of longs and strings."""
    seed = SEED
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def long(x):
    return (x & (1 << 64) - 1).to_bytes(8, "little")


def whole(x):
    return (x & (1 << 32) - 1).to_bytes(4, "little")


def shingles(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_fingerprint(text):
    """Bins by a loop, each borrowing in its own random order."""
    bins = {}
    for s in shingles(text):
        x = h64(*(long(h64(w)) for w in s)) & -2
        b = (x >> 56) + 128
        bins[b] = min(x, bins.get(b, x))
    if not bins:
        return ""
    tables = [[draw.randrange(256) for _ in range(256)] for draw in (random.Random(t) for t in range(fp.TRIES))]
    digits = []
    for b in range(256):
        donors = [b, *(t[b] for t in tables), *sorted(bins, key=lambda d: h64(whole(b), long(d - 128)) & -256)]
        donor = next(d for d in donors if d in bins)
        digits.append(f"{h64(long(bins[donor]), whole(b)) & 15:X}")
    return "".join(digits)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (share - 1 / 16) / (1 - 1 / 16))


def plain_edits(rows):
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        prints = [plain_fingerprint(t) for t in (text, edited, after)]
        out[doc_id, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], plain_likeness(*prints[:2]), plain_likeness(prints[0], prints[2]))
    return out


def found_rows(spark, frame, rows, tmp_path):
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    return fp.query(spark, str(tmp_path)).collect()


def check(found, want, rows):
    got = sorted((r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    flat = (want[r[0], r[1] or ""] for r in rows)
    assert got == sorted((r[0] is None, r[0], *v[:4], *(round(x, 9) for x in v[4:])) for r, v in zip(rows, flat, strict=True))


def test_equals_plain_version(spark, frame, prose, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "one  Two\tthree", "日本語 😀 ﬁn a b c d e", prose(1, 400), prose(1, 400), prose(2, 2000), "x" * 5000, "a " * 700]
    texts += [prose(rng.randrange(10**6), rng.randrange(1, 60)) for _ in range(25)]
    rows = list(zip(rng.sample(range(-50, 10**12), len(texts)), texts, strict=True))
    rng.shuffle(rows)
    check(found_rows(spark, frame, rows, tmp_path), plain_edits(rows), rows)


@pytest.mark.parametrize("rows", [
    [],
    [(7, "the only one here is this")],
    [(1, "same row twice in a table"), (1, "same row twice in a table"), (2, "another text of some six words"), (None, "no id"), (None, "no id")],
])
def test_repeated_null_single_and_empty(spark, frame, rows, tmp_path):
    check(found_rows(spark, frame, rows, tmp_path), plain_edits(rows), rows)


def test_equal_ids_each_have_a_place(spark, frame, tmp_path):
    found = found_rows(spark, frame, [(1, "first text"), (1, "second text"), (2, None)], tmp_path)
    assert sorted((r.doc_id, r.n_chars) for r in found) == [(1, 10), (1, 11), (2, 0)]


def test_estimates_are_close_and_unbiased(spark, prose):
    rows = []
    for i in range(60):
        words = prose(i, 300 + 10 * i).split()
        changed = list(words)
        for j in range(i % 12):
            changed[(j * 37) % len(changed)] = f"new{j}"
        rows.append((" ".join(words), " ".join(changed)))
    df = fp.with_fingerprint(fp.with_fingerprint(spark.createDataFrame(rows, "a string, b string"), F.col("a"), "x"), F.col("b"), "y")
    errors = []
    for r in df.select("a", "b", fp.likeness(F.col("x"), F.col("y")).alias("near")).collect():
        a, b = shingles(r.a), shingles(r.b)
        errors.append(r.near - len(a & b) / len(a | b))
    assert abs(sum(errors)) / len(errors) < 0.02 and max(map(abs, errors)) < 0.15


def test_native_plan(spark, frame, tmp_path):
    frame([(1, "a b c")]).write.parquet(f"{tmp_path}/documents.parquet")
    plan = fp.query(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
