"""The stream of episodes against the fold over whole tables."""

from __future__ import annotations

import random
import time

import pytest

from proofset.operators import trajectories
from proofset.streaming import episodes

CALL, ANSWER = '<tool>{"name": "list_tables", "args": {}}</tool>', "```sql\nSELECT 1\n```"


@pytest.fixture
def folders(tmp_path):
    return tuple(f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))


def feed(spark, folders, rows):
    """Append a file of (episode, step, text) and let the stream take it."""
    spark.createDataFrame(rows, "episode long, step int, text string").coalesce(1).write.mode("append").parquet(folders[0])
    texts = spark.readStream.schema("episode long, step int, text string").option("maxFilesPerTrigger", 1).parquet(folders[0])
    query = episodes.start(texts, folders[1], folders[2])
    assert query.awaitTermination(120)


def test_equals_the_fold_in_any_order_and_over_restarts(spark, folders):
    rng = random.Random(5)
    plans = {i: [rng.choice([CALL, ANSWER, "hm", None, ""]) if rng.random() < 0.8 else "hm" for _ in range(rng.randrange(1, 7))] for i in range(60)}
    rows = [(i, k + 1, t) for i, texts in plans.items() for k, t in enumerate(texts)]
    rng.shuffle(rows)
    for part in (rows[::3], rows[1::3], rows[2::3]):
        feed(spark, folders, part)
    found = {r.episode: (r.reason, r.turns, r.tool_calls, r.final_sql) for r in episodes.outcomes(spark, folders[1], folders[2]).collect()}
    frame = spark.createDataFrame(list(plans.items()), "id long, actions array<string>")
    assert found == {r.id: (r.reason, r.turns, r.tool_calls, r.final_sql) for r in trajectories.replay(frame).collect()}
    assert len({v[0] for v in found.values()}) == 4
    events = spark.read.schema(episodes.OUT).parquet(folders[1])
    assert events.groupBy("episode", "step").count().filter("count > 1").isEmpty()


def test_late_and_repeated_texts(spark, folders):
    feed(spark, folders, [(1, 1, "hm"), (1, 1, "a hm"), (1, 3, CALL), (2, 2, ANSWER), (None, 1, ANSWER), (3, 0, "x"), (3, None, "x")])
    feed(spark, folders, [(1, 2, ANSWER), (1, 1, "again"), (2, 1, CALL), (2, 1, ANSWER)])
    feed(spark, folders, [(1, 4, "after"), (2, 2, ANSWER)])
    rows = spark.read.schema(episodes.OUT).parquet(folders[1]).collect()
    seen = sorted((r.episode is None, r.episode or 0, r.event, r.step or 0, r.reason or "") for r in rows)
    assert seen == sorted([
        (False, 1, "correction", 1, ""), (False, 1, "repeated", 1, ""), (False, 1, "repeated", 1, ""), (False, 1, "end", 2, "submitted"), (False, 1, "late", 3, ""), (False, 1, "late", 4, ""),
        (False, 2, "end", 1, "submitted"), (False, 2, "repeated", 1, ""), (False, 2, "late", 2, ""), (False, 2, "late", 2, ""), (True, 0, "end", 1, "submitted"), (False, 3, "late", 0, ""), (False, 3, "late", 0, ""),
    ])
    assert {r.content for r in rows if r.event == "correction"} == {trajectories.CORRECTION}


def test_idle_episodes_end(spark, folders):
    spark.createDataFrame([(1, 1, CALL), (2, 1, ANSWER), (3, 2, "hm")], "episode long, step int, text string").write.parquet(folders[0])
    texts = spark.readStream.schema("episode long, step int, text string").parquet(folders[0])
    query = episodes.start(texts, folders[1], folders[2], idle_seconds=1)
    found, until = set(), time.monotonic() + 90
    while len(found) < 4 and time.monotonic() < until and query.isActive:
        time.sleep(1)
        if query.lastProgress:
            found = {(r.episode, r.event, r.reason, r.turns) for r in spark.read.schema(episodes.OUT).parquet(folders[1]).filter("event <> 'call'").collect()}
    query.stop()
    assert found == {(1, "end", "timed_out", 1), (2, "end", "submitted", 1), (3, "late", None, 0), (3, "end", "timed_out", 0)}
