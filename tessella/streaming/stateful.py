"""Keyed state over event streams: leases and retries of tasks, logs followed from a cursor, and stages that can be resumed.

``task_transitions`` is one fold over the events of a task, which a stream keeps as state with a timer for the lease, and a table
gives at once; both give the same answer for the same events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.streaming.events import RETRY_AFTER

#: How long a claim holds without a further sign of life.
LEASE_SECONDS = 86_400
_STATE = "status string, attempt int, due long, lease long, n long"
_OUT = "id long, n long, status string, attempt int, at long"

State = tuple[str, int, int, int, int]  # status, attempt, due and end of the lease in milliseconds, transitions so far
_NEW: State = ("none", 0, 0, 0, 0)


def _failed(state: State, at: int) -> State:
    _, attempt, _, _, n = state
    if attempt > len(RETRY_AFTER):
        return "failed", attempt, 0, 0, n + 1
    return "pending", attempt, at + 1000 * RETRY_AFTER[attempt - 1], 0, n + 1


def expired(state: State, now: int) -> State:
    """The state at a time: a running task whose lease ended before has failed when it ended."""
    return _failed(state, state[3]) if state[0] == "running" and state[3] < now else state


def after_event(state: State, kind: str, at: int) -> State:
    """The state after an event: ``submit`` makes a task that is not under way pending, ``claim`` takes one that is due, ``beat``
    renews the lease, ``done`` and ``error`` end the attempt. Others, and events that do not fit the state, change nothing."""
    status, attempt, due, lease, n = state
    if kind == "submit" and status in ("none", "done", "failed"):
        return "pending", 0, at, 0, n + 1
    if kind == "claim" and status == "pending" and due <= at:
        return "running", attempt + 1, 0, at + 1000 * LEASE_SECONDS, n + 1
    if kind == "beat" and status == "running":
        return status, attempt, due, at + 1000 * LEASE_SECONDS, n
    if kind == "done" and status == "running":
        return "done", attempt, 0, 0, n + 1
    if kind == "error" and status == "running":
        return _failed(state, at)
    return state


def _fold(key: int, state: State, events: list[tuple[int, int, str]]) -> tuple[State, list[tuple]]:
    """The state after events (milliseconds, sequence, kind), and a row for each transition."""
    rows = []
    for at, _, kind in sorted(events):
        for new in (expired(state, at), None):
            before, state = state, new if new is not None else after_event(state, kind, at)
            if state[4] != before[4]:
                rows.append((key, state[4], state[0], state[1], before[3] if new is not None else at))
    return state, rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "n", "status", "attempt", "at"])


def task_transitions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(id, n, status, attempt, at): the transitions of each task, from a stream of events (id, seq, kind, at: timestamp) whose
    files bring the events of a task in their order. A lease ends by a timer once the watermark, ``delay`` behind the latest
    event, has passed it. A task holds five values between batches, and all of its events of one batch are in one task."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state: State = tuple(held.get) if held.exists else _NEW
        if held.hasTimedOut:
            new = expired(state, held.getCurrentWatermarkMs())
            rows = [(key[0], new[4], new[0], new[1], state[3])] if new[4] != state[4] else []
            state = new
        else:
            found = pd.concat(list(frames))
            times = (found["at"].astype("datetime64[ms]").astype("int64")).tolist()
            state, rows = _fold(key[0], state, list(zip(times, found["seq"].tolist(), found["kind"].tolist(), strict=True)))
        held.update(state)
        if state[0] == "running":
            held.setTimeoutTimestamp(max(state[3], held.getCurrentWatermarkMs() + 1))
        yield _frame(rows)

    stream = events.select("id", "seq", "kind", "at").withWatermark("at", delay)
    return stream.groupBy("id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def task_states(events: DataFrame, now_millis: int) -> DataFrame:
    """(id, status, attempt): the states at a time, by the same fold over a table of events (id, seq, kind, at)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        times = frame["at"].astype("datetime64[ms]").astype("int64").tolist()
        key = int(frame["id"].iloc[0])
        state, _ = _fold(key, _NEW, list(zip(times, frame["seq"].tolist(), frame["kind"].tolist(), strict=True)))
        state = expired(state, now_millis)
        return pd.DataFrame([(key, state[0], state[1])], columns=["id", "status", "attempt"])

    return events.select("id", "seq", "kind", "at").groupBy("id").applyInPandas(run, "id long, status string, attempt int")


def latest_states(transitions: DataFrame) -> DataFrame:
    """(id, status, attempt) after the last transition of each task."""
    last = transitions.groupBy("id").agg(F.max_by(F.struct("status", "attempt"), "n").alias("s"))
    return last.select("id", "s.status", "s.attempt")


def follow(spark: SparkSession, log: str, cursor: str, out: str, checkpoint: str) -> DataFrame:
    """The events of a log (``events.appended``) after an exclusive cursor ``major-minor``, each once however often this is called:
    files that came since the last call with the same checkpoint are read, and appended to ``out``."""
    schema = "run_id string, seq string, envelope string, drop_after long"
    major, minor = (int(x) for x in cursor.split("-"))
    part = lambda i: F.split_part("seq", F.lit("-"), F.lit(i)).cast("long")
    after = (part(1) > major) | ((part(1) == major) & (part(2) > minor))
    stream = spark.readStream.schema(schema).parquet(log).filter(after)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(stream: DataFrame, stages: list[Stage], out: str, checkpoint: str) -> None:
    """Each micro-batch goes through the stages, one table each in ``out``: a stage reads what the one before has written of the
    batch. A batch's rows are one folder of a table (``batch=...``), which is overwritten: a run that is killed between
    stages repeats the batch, and the tables end as without it."""

    def each(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, batch
        for name, stage in stages:
            path = f"{out}/{name}/batch={number}"
            made = stage(now)
            made.write.mode("overwrite").parquet(path)
            now = spark.read.schema(made.schema).parquet(path)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
