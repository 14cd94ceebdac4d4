from __future__ import annotations

import zlib

from proofset.llm import sharding as op


def check(got, rows, slack):
    assert sorted(((r.id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    by_shard = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    sizes = [sum(r.size for r in by_shard.get(s, [])) for s in range(op.SHARDS)]
    assert max(sizes) - min(sizes) <= slack, sizes
    return by_shard


def test_near_equal_bytes(spark, frame, prose):
    rows = [(i, prose(i, 1 + i % 90)) for i in range(2000)]
    total = sum(len(t) + 1 for _, t in rows)
    by_shard = check(op.shard(frame(rows)).collect(), rows, 0.02 * total)
    texts = {}
    for s, part in by_shard.items():
        for r in part:
            texts.setdefault(r.text_crc32, set()).add(s)
    assert all(len(s) == 1 for s in texts.values())


def test_hot_text_is_subdivided(spark, frame, prose):
    rows = [(i, "the same text again " * 5) for i in range(1500)] + [(5000 + i, prose(i, 20)) for i in range(1500)]
    total = sum(len(t) + 1 for _, t in rows)
    check(op.shard(frame(rows)).collect(), rows, 0.03 * total)


def test_odd_rows(spark, frame, odd_rows):
    check(op.shard(frame(odd_rows)).collect(), odd_rows, 10**7)
    assert op.shard(frame([])).count() == 0
    check(op.shard(frame([(1, "only")])).collect(), [(1, "only")], 10)


def test_equal_inputs_equal_shards(spark, frame, prose):
    rows = [(i, prose(i, 30)) for i in range(300)]
    a, b = (sorted(map(tuple, op.shard(frame(rows).repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_plan_is_native(spark, frame):
    plan = op.shard(frame([(1, "x"), (2, "y")]))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "EvalPython" not in plan
