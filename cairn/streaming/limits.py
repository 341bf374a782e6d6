"""Order-dependent limits: quotas, token buckets, cooldowns and key rotation.

A limit is a step function ``(state, at, size) -> (state, verdict)`` on a small tuple of
numbers. The same step runs over a finished table (``replay``) and over a stream
(``limit_stream``), so both give the same verdicts for the same order of events.

``replay`` sorts events inside hash partitions of the key and walks through them as a
stream: a task holds one state, not a key's events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = tuple[float, ...]
Step = Callable[[State | None, float, float], tuple[State, str]]


def quota(per_window: int, window: float) -> Step:
    """A number of events in a window that begins with the first event after the last window ended."""

    def step(state: State | None, at: float, size: float) -> tuple[State, str]:
        start, used = state if state and at - state[0] < window else (at, 0.0)
        return ((start, used), "rejected") if used >= per_window else ((start, used + 1), "admitted")

    return step


def token_bucket(capacity: float, per_second: float) -> Step:
    """A bucket that refills all the time; an event takes one token."""

    def step(state: State | None, at: float, size: float) -> tuple[State, str]:
        tokens, last = state or (capacity, at)
        tokens = min(capacity, tokens + max(0.0, at - last) * per_second)
        return ((tokens - 1, at), "admitted") if tokens >= 1 else ((tokens, at), "rejected")

    return step


def cooldown(seconds: float) -> Step:
    """After an admitted event, none for some seconds."""

    def step(state: State | None, at: float, size: float) -> tuple[State, str]:
        return (state, "suppressed") if state and at - state[0] < seconds else ((at,), "admitted")

    return step


def rotation(max_age: float, max_bytes: float) -> Step:
    """A new epoch when the present one is too old or has carried too many bytes; the verdict is its number."""

    def step(state: State | None, at: float, size: float) -> tuple[State, str]:
        epoch, since, carried = state or (0.0, at, 0.0)
        if at - since >= max_age or carried + size > max_bytes and carried:
            epoch, since, carried = epoch + 1, at, 0.0
        return (epoch, since, carried + size), str(int(epoch))

    return step


def working_set(capacity: int, ttl: float) -> Callable[[list], list]:
    """The ids that stay of ``(id, score, inserted_at)`` pushed one by one: expired ones go, then the lowest scores."""

    def keep(entries: list) -> list:
        held: list = []
        for e in entries:
            held = [h for h in held if h[2] + ttl > e[2]]
            held.append(e)
            if len(held) > capacity:
                held.remove(min(held, key=lambda h: (h[1], h[2])))
        return [h[0] for h in held]

    return keep


def replay(events: DataFrame, key: str, at: str, id_: str, step: Step, size: str | None = None) -> DataFrame:
    """``(id, key, verdict)`` of each event, in order of time and id within its key. A null time is 0."""
    named = events.select(F.col(id_).alias("id"), F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at"), (F.col(size).cast("double") if size else F.lit(0.0)).alias("size"))
    id_type = named.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            verdicts = []
            for k, t, s in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k != now:
                    now, state = k, None
                state, verdict = step(state, t or 0.0, s or 0.0)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(verdicts, pa.string())], names=["id", "key", "verdict"])

    return named.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, f"id {id_type}, key string, verdict string")


def limit_stream(events: DataFrame, key: str, at: str, id_: str, step: Step, width: int, size: str | None = None) -> DataFrame:
    """The same on a stream: ``(id, key, verdict)``, with ``width`` numbers of state for each key."""
    named = events.select(F.col(id_).cast("string").alias("id"), F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at"), (F.col(size).cast("double") if size else F.lit(0.0)).alias("size"))
    fields = ", ".join(f"s{i} double" for i in range(width))

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        verdicts = []
        for t, s in zip(rows["at"], rows["size"], strict=True):
            state, verdict = step(state, t, s)
            verdicts.append(verdict)
        held.update(tuple(map(float, state)))
        yield pd.DataFrame({"id": rows["id"], "key": keys[0], "verdict": verdicts})

    return named.groupBy("key").applyInPandasWithState(run, "id string, key string, verdict string", fields, "append", GroupStateTimeout.NoTimeout)
