"""Episodes of a policy as a stateful stream.

Texts of policies arrive as rows (episode, step, text), in any order and in any batch;
what each of them gets leaves as rows. An episode's state is how far it has come and the
texts that came ahead of their turn. A statement submits and ends it; a tool call, or a
text that is neither, is answered and goes on, at turn ``max_turns`` either ends it. So
ended episodes equal the fold over whole tables (``trajectories.replay``).

Rows that leave: episode, step, event, content, reason, turns, tool_calls, final_sql.

Defined results
    call          a tool call, whose text is the content: to be answered
    correction    neither a call nor a statement; the content is what the policy is told
    end           with the reason, and the counts until there
    repeated      a step that was there before; the first text stays, and of several in
                  one batch the smallest
    late          a text for an episode that has ended, or that waited beyond its end
    a step ahead  waits in the state until those before it have come
    null text     as the empty text; null or non-positive steps are ``late``
    no text for ``idle_seconds``    the episode ends as ``timed_out``
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from proofset.functions import text as tx
from proofset.operators.trajectories import CORRECTION, MAX_TURNS

OUT = "episode long, step int, event string, content string, reason string, turns int, tool_calls int, final_sql string"
PROGRESS = "done int, tool_calls int, ended boolean, timer long"
WAITING = "kind string, content string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


def _processor(max_turns: int, idle_seconds: float | None):
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    correction = CORRECTION

    def told(episode, step, event, content=None, reason=None, done=0, calls=0, sql=None):
        return Row(episode=episode, step=step, event=event, content=content, reason=reason, turns=done, tool_calls=calls, final_sql=sql)

    class Episode(StatefulProcessor):  # within a function, so that workers get it by value
        def init(self, handle) -> None:
            self.handle = handle
            self.progress = handle.getValueState("progress", PROGRESS)
            self.waiting = handle.getMapState("waiting", "step int", WAITING)

        def close(self) -> None:
            pass

        def handleInputRows(self, key, rows, timerValues):
            done, calls, ended, timer = self.progress.get() if self.progress.exists() else (0, 0, False, None)
            row = lambda step, event, content=None, reason=None, sql=None: told(key[0], step, event, content, reason, done, calls, sql)
            for r in sorted(rows, key=lambda r: (r.step is None, r.step or 0, r.kind, r.content)):
                if ended or r.step is None or r.step < 1:
                    yield row(r.step, "late", r.content)
                elif r.step <= done or self.waiting.containsKey((r.step,)):
                    yield row(r.step, "repeated", r.content)
                else:
                    self.waiting.updateValue((r.step,), (r.kind, r.content))
            while not ended and self.waiting.containsKey((done + 1,)):
                kind, content = self.waiting.getValue((done + 1,))
                self.waiting.removeKey((done + 1,))
                done += 1
                calls += kind == "call"
                last = done >= max_turns
                ended = kind == "answer" or last
                if ended:
                    reason = "submitted" if kind == "answer" else "max_turns" if kind == "call" else "malformed_final"
                    yield row(done, "end", None, reason, content if kind == "answer" else "")
                else:
                    yield row(done, "call", content) if kind == "call" else row(done, "correction", correction)
            if ended:
                for (step,), (_, content) in sorted(self.waiting.iterator()):
                    yield row(step, "late", content)
                self.waiting.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
                timer = None
            if idle_seconds is not None and not ended:
                timer = timerValues.getCurrentProcessingTimeInMs() + int(1000 * idle_seconds)
                self.handle.registerTimer(timer)
            self.progress.update((done, calls, ended, timer))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            done, calls, ended, _ = self.progress.get()
            if not ended:
                for (step,), (_, content) in sorted(self.waiting.iterator()):
                    yield told(key[0], step, "late", content, None, done, calls)
                self.waiting.clear()
                self.progress.update((done, calls, True, None))
                yield told(key[0], done, "end", None, "timed_out", done, calls, "")

    return Episode()


def episodes(texts: DataFrame, max_turns: int = MAX_TURNS, idle_seconds: float | None = None) -> DataFrame:
    """The rows that leave for a stream of ``texts`` (episode, step, text).

    Texts are read by the engine's expressions; the state sees only what they are.
    """
    text = F.coalesce("text", F.lit(""))
    statement = tx.extract_statement(text)
    call = tx.tool_call(text).isNotNull()
    kind = F.when(call, "call").when(tx.looks_like_select(statement), "answer").otherwise("bad")
    content = F.when(call, F.regexp_extract(text, tx.TOOL_CALL, 1)).otherwise(statement)
    seen = texts.select(F.col("episode").cast("long").alias("episode"), F.col("step").cast("int").alias("step"), kind.alias("kind"), content.alias("content"))
    return seen.groupBy("episode").transformWithState(_processor(max_turns, idle_seconds), OUT, "Append", "None" if idle_seconds is None else "ProcessingTime")


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def start(texts: DataFrame, out: str, checkpoint: str, max_turns: int = MAX_TURNS, idle_seconds: float | None = None) -> StreamingQuery:
    """The running query. Without ``idle_seconds`` it takes all texts that are there and ends;
    with timers it goes on until it is stopped. Started again it goes on from ``checkpoint``."""
    with _state_on_disk(texts.sparkSession):
        found = episodes(texts, max_turns, idle_seconds).writeStream.format("parquet").outputMode("append")
        found = found.trigger(availableNow=True) if idle_seconds is None else found.trigger(processingTime="1 second")
        return found.option("path", out).option("checkpointLocation", checkpoint).start()


def outcomes(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """One row per episode: how it ended, or ``unfinished`` with what the state knows of it."""
    ended = spark.read.schema(OUT).parquet(out).filter("event = 'end'").select("episode", "reason", "turns", "tool_calls", "final_sql")
    with _state_on_disk(spark):
        state = spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
        state = state.select(F.col("key").getField(state.schema["key"].dataType.fieldNames()[0]).alias("episode"), "value.*")
    running = state.filter("NOT ended").select("episode", F.lit("unfinished").alias("reason"), F.col("done").alias("turns"), "tool_calls", F.lit("").alias("final_sql"))
    return ended.union(running)
