"""The audit against applying the filters one after the other, in every order."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from proofset.llm import filter_audit as fa


def fails(rows, letter, row):
    doc_id, text = row[0], row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if letter == "A":
        return len(words) < 100
    if letter == "B":
        return 100 * len(set(words)) < 80 * len(words)
    if letter == "C":
        return 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)
    if letter == "D":
        return bool(set("#$%&*|") & set(text))
    ids = [r[0] for r in rows if (r[1] or "") == text]
    return any(i is not None and (doc_id is None or i < doc_id) for i in ids)


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = [(r, {x for x in "ABCDE" if fails(rows, x, r)}) for r in rows]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        alive = defaultdict(list)
        gone = defaultdict(list)
        for r, f in failed:
            alive[r[2] or ""].append((r, f))
        for step, x in enumerate(order, 1):
            for part in {r[2] or "" for r in rows}:
                away = [(r, f) for r, f in alive[part] if x in f]
                redundant = sum(x in f for _, f in gone[part])
                gone[part] += away
                alive[part] = [(r, f) for r, f in alive[part] if x not in f]
                unique = sum(f == {x} for r, f in failed if (r[2] or "") == part)
                out[part, order, step] = (len(alive[part]), len(away), redundant, unique, sum(r[0] in good for r, _ in away), sum(r[0] in toxic for r, _ in away))
                shapley[part, x] += len(away)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found(spark, frame, rows, labels, tmp_path):
    frame(rows).withColumn("lang", F.expr("nullif(lang, 'none')")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in fa.query(spark, str(tmp_path)).collect()}


def test_equals_plain_version(spark, frame, prose, tmp_path):
    texts = [None, "", " \t", "A" * 30, prose(1, 150), prose(1, 150) + " #", prose(2, 150).upper(), "same " * 120, "SAME* " * 120, prose(3, 99), prose(3, 100), "é" * 9 + "A", "É" * 9 + "AB"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t, "de") for i, t in enumerate(texts[::2])] + [(200, texts[4], "none")]
    rows += [(5, texts[5], "en"), (4, texts[4], "de"), (None, texts[4], "en"), (None, "only without id", "en"), (None, "only without id", "en")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 110)] + [(4, None, 1), (4, 1, None), (999, 1, 1), (200, None, None)]
    plain_rows = [(i, t, None if lang == "none" else lang) for i, t, lang in rows]
    got = found(spark, frame, rows, labels, tmp_path)
    assert got == plain(plain_rows, labels) and len(got) == 3 * 600


def test_empty_tables(spark, frame, tmp_path):
    assert found(spark, frame, [], [], tmp_path) == {}


def test_no_labels(spark, frame, tmp_path):
    got = found(spark, frame, [(1, "a $", "en")], [], tmp_path)
    assert len(got) == 600 and got["en", "DABCE", 1] == (0, 1, 0, 0, 0, 0, 60)
