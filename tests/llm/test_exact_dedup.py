from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from proofset.llm import exact_dedup as op


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        out += [(i, first, len(ids), i == first, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark, frame, odd_rows):
    rows = [*odd_rows, (20, "a  b"), (21, "a\tb"), (22, "a b "), (23, "A b")]
    assert found(op.exact_dedup(frame(rows))) == brute(rows)


def test_hot_group(spark, frame):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(100)]
    assert found(op.exact_dedup(frame(rows).repartition(7))) == brute(rows)


def test_empty_table(spark, frame):
    assert op.exact_dedup(frame([])).count() == 0


def test_digest_collision_is_resolved_on_bytes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, body string")
    assert {(r.id, r.keep_id, r.group_size) for r in op._by_text(rows).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}


def test_bitmap_keeps_every_hit(spark):
    rows = spark.range(5000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    hits = rows.filter("id % 7 = 0").select("digest")
    passed = {r.id for r in op._of_hits(rows, hits).collect()}
    assert passed >= set(range(0, 5000, 7)) and len(passed) < 1000


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    def digests(ids):
        return spark.createDataFrame([(bytes([i % 3]), i, ("f", 1)) for i in ids], "digest binary, id long, locator struct<file:string,bytes:int>")

    first = digests([5, 4, 6])
    first.write.parquet(str(tmp_path / "in"))
    state = op.stream_state(spark, str(tmp_path / "in"), first.schema, str(tmp_path / "checkpoint"))
    assert {(r.first.id, r.n) for r in state.collect()} == {(5, 1), (4, 1), (6, 1)}
    digests([1, 9]).write.mode("append").parquet(str(tmp_path / "in"))
    state = op.stream_state(spark, str(tmp_path / "in"), first.schema, str(tmp_path / "checkpoint"))
    assert {(r.first.id, r.n) for r in state.collect()} == {(5, 1), (1, 2), (6, 2)}


def test_drop_keeps_columns(spark, frame):
    docs = frame([(1, "a"), (2, "a"), (3, "b"), (None, "c")])
    out = op.drop_exact_copies(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3, None}


#: One id on two texts, copies without an id, repeated rows, a group without any id.
MIXED = [(3, "x y z"), (5, "x y z"), (5, "different text kept"), (None, "x  y z"), (None, "nobody"), (None, "nobody"), (8, "again"), (8, "again"), (9, None), (2, ""), (5, "different\ttext kept")]


def plain_drop(rows):
    """One row of each group of equal texts, with the smallest id, ids before none."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted(((min((i for i in ids if i is not None), default=None), body) for body, ids in groups.items()), key=str)


def dropped(df):
    return sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in df.collect()), key=str)


def test_drop_leaves_one_row(spark, frame):
    out = op.drop_exact_copies(frame(MIXED).repartition(4))
    assert dropped(out) == plain_drop(MIXED)
    assert found(op.exact_dedup(frame(MIXED))) == brute(MIXED)


def test_drop_of_repeated_rows(spark, frame):
    rows = [(3, "q"), (3, "q"), (7, "q"), (None, "x y z"), (None, "x  y z"), (4, "u v"), (4, "u\tv"), (6, "u v"), (5, None), (5, "")]
    assert dropped(op.drop_exact_copies(frame(rows).repartition(3))) == plain_drop(rows)
    hot = [(1, "hot"), (None, "none")] * 300 + [(2, "hot")] * 100
    assert dropped(op.drop_exact_copies(frame(hot).repartition(6))) == [(1, "hot"), (None, "none")]


def test_drop_takes_the_same_of_rows_that_differ_elsewhere(spark, frame):
    docs = frame([(1, "t", "b"), (1, "t", "a"), (1, "t", "c"), (2, "u", "d")])
    got = [{(r.doc_id, r.lang) for r in op.drop_exact_copies(docs.repartition(n)).collect()} for n in (1, 3, 4)]
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]


def test_drop_by_row_many(spark, frame):
    rows = [(i % 70, f"text {i % 90}" if i % 3 else "hot") for i in range(600)]
    assert dropped(op.drop_exact_copies(frame(rows).repartition(5))) == plain_drop(rows)
