"""Schedules with timers in state: instances that are due by interval, and later after failures.

A stream of commands says what is scheduled. Each instance has one state, its plan, and one
timer, which the state store fires; nothing polls all instances. When a timer fires, the
instance is due: one row goes out, and the timer is set to the next time of its own rhythm
that is still to come. Times that passed while nobody ran are one tick, which says how many
were missed. After a failure the next time is ``interval * 2**failures`` away, ``longest`` at
most; a success brings the rhythm back.

Commands, in order of ``at``: ``schedule`` (with ``interval``, in milliseconds; one of zero or less is
ignored; of a known instance it replaces the plan), ``unschedule``, ``failed``, ``done``. Unknown commands, and
``failed`` or ``done`` of an instance that isn't scheduled, change nothing. A null instance is none.

``Plan`` has all the rules and no Spark in it. With processing time the clock is that of the
cluster; with event time it is the stream's watermark, so a replay gives the same ticks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

DOUBLINGS = 30


@dataclass
class Plan:
    """interval and times in milliseconds; due: the next time."""

    interval: int
    due: int
    failures: int = 0

    def delay(self, longest: int) -> int:
        """The time to the next tick."""
        if not self.failures:
            return self.interval
        return max(self.interval, min(longest, self.interval * 2 ** min(self.failures, DOUBLINGS)))

    def tick(self, now: int, longest: int) -> tuple[int, int, int]:
        """An instance is due: when it should have been, how many later times have passed as well, and its failures. Then the next time follows."""
        step = self.delay(longest)
        missed = max(0, (now - self.due) // step)
        was = self.due
        self.due += (missed + 1) * step
        return was, missed, self.failures

    def failed(self, at: int, longest: int) -> None:
        self.failures += 1
        self.due = at + self.delay(longest)

    def done(self, at: int) -> None:
        """The rhythm is as before; only an instance that had failed gets another time."""
        if self.failures:
            self.failures = 0
            self.due = at + self.interval


def command(plan: Plan | None, kind: str, interval: int | None, at: int, longest: int) -> Plan | None:
    """An instance's plan after a command; None: it isn't scheduled."""
    if kind == "schedule":
        return plan if interval is None or interval <= 0 else Plan(interval, at + interval)
    if kind == "unschedule":
        return None
    if plan is not None and kind == "failed":
        plan.failed(at, longest)
    elif plan is not None and kind == "done":
        plan.done(at)
    return plan


#: Made without a parser, which only a driver has.
STATE = StructType([StructField("interval", LongType()), StructField("due", LongType()), StructField("failures", IntegerType())])
TICK = "instance string, due bigint, at bigint, missed bigint, failures int"


class Scheduler(StatefulProcessor):
    """The state of one instance is its plan; its timer is set to the plan's next time."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("plan", STATE)

    def _read(self) -> Plan | None:
        return Plan(*map(int, self.state.get())) if self.state.exists() else None

    def _write(self, plan: Plan | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if plan is None:
            self.state.clear()
        else:
            self.state.update((plan.interval, plan.due, plan.failures))
            self.handle.registerTimer(plan.due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plan = self._read()
        for r in pd.concat(list(rows)).sort_values(["at", "kind"]).itertuples(index=False):
            interval = None if r.interval is None or (isinstance(r.interval, float) and math.isnan(r.interval)) else int(r.interval)
            plan = command(plan, r.kind, interval, int(r.at), self.longest)
        self._write(plan)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plan = self._read()
        # a timer set before the last command has nothing to say
        if plan is None or expiredTimerInfo.getExpiryTimeInMs() != plan.due:
            return iter(())
        event = timerValues.getCurrentWatermarkInMs()
        now = max(plan.due, event if event > 0 else timerValues.getCurrentProcessingTimeInMs())
        due, missed, failures = plan.tick(now, self.longest)
        self.handle.registerTimer(plan.due)
        self.state.update((plan.interval, plan.due, plan.failures))
        return iter([pd.DataFrame([(key[0], due, now, missed, failures)], columns=["instance", "due", "at", "missed", "failures"])])

    def close(self) -> None:
        pass


def ticks(commands: DataFrame, longest: int = 3_600_000, time_mode: str = "ProcessingTime") -> DataFrame:
    """``(instance, due, at, missed, failures)`` on a stream of commands (instance, kind, interval, at in milliseconds).

    With ``EventTime`` the commands have a watermark on a column ``moment``. The session's state store must be
    the one with timers: see ``use_timers``.
    """
    kept = [F.col("instance").cast("string").alias("instance"), F.col("kind").cast("string").alias("kind"), F.col("interval").cast("bigint").alias("interval"), F.col("at").cast("bigint").alias("at")]
    named = commands.select(*kept, *(["moment"] if time_mode == "EventTime" else [])).where("instance IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL")
    return named.groupBy("instance").transformWithStateInPandas(Scheduler(longest), TICK, "Append", time_mode)


def use_timers(spark) -> None:
    """State with timers needs the store that is kept on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def plain_ticks(commands: list[tuple[str, str, int | None, int]], clock: list[int], longest: int) -> list[tuple]:
    """The same without Spark: all commands up to each time of the clock, then what is due, an instance once each time."""
    plans: dict[str, Plan | None] = {}
    out, todo = [], sorted(commands, key=lambda c: (c[3], c[1]))
    for now in clock:
        while todo and todo[0][3] <= now:
            name, kind, interval, at = todo.pop(0)
            plans[name] = command(plans.get(name), kind, interval, at, longest)
        for name in sorted(n for n, p in plans.items() if p is not None and p.due <= now):
            out.append((name, *_row(plans[name], now, longest)))
    return out


def _row(plan: Plan, now: int, longest: int) -> tuple:
    due, missed, failures = plan.tick(now, longest)
    return due, now, missed, failures


def replay(commands: DataFrame, until: int, longest: int = 3_600_000) -> DataFrame:
    """``(instance, due, at, missed, failures)`` of a finished table of commands, as if the clock had stood at every moment up to ``until``: no tick is late.

    Commands come sorted by instance and time; a task holds one plan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, plan = None, None
        for b in batches:
            out: list[tuple] = []
            for i, kind, interval, at in zip(*(b.column(c).to_pylist() for c in ("instance", "kind", "interval", "at")), strict=True):
                if i != name:
                    out += _until(name, plan, until, longest)
                    name, plan = i, None
                if at > until:
                    continue
                out += _until(name, plan, at - 1, longest)
                plan = command(plan, kind, interval, at, longest)
            yield _ticks(out)
        yield _ticks(_until(name, plan, until, longest))

    named = commands.select(F.col("instance").cast("string").alias("instance"), "kind", F.col("interval").cast("bigint").alias("interval"), F.col("at").cast("bigint").alias("at")).where("instance IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL")
    return named.repartition("instance").sortWithinPartitions("instance", "at", "kind").mapInArrow(run, TICK)


def _until(name: str | None, plan: Plan | None, until: int, longest: int) -> list[tuple]:
    out = []
    while plan is not None and plan.due <= until:
        now = plan.due
        due, missed, failures = plan.tick(now, longest)
        out.append((name, due, now, missed, failures))
    return out


def _ticks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["instance", "due", "at", "missed", "failures"])
