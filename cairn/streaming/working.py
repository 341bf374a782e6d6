"""Working memory: for each scope a window of at most so many entries, each for so long.

An entry that is pushed first drives out those whose time is over, then, while the window is
full, the one of the lowest relevance (of equal ones the oldest); then it is held, whatever
its own relevance. ``Window`` holds entries in two heaps, by relevance and by end, so a push
costs the logarithm of the capacity. The same window runs over a table (``replay``: rows come
sorted, a task holds one window) and over a stream (``stream``: a scope's window is its
state, of at most ``capacity`` entries), one entry at a time in order of time and id.

A null relevance counts as the lowest, a NaN as the highest; a null time is 0; a null or
negative time to live ends at once, and such an entry is never live. Repeated ids are entries of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EXPIRED, CROWDED = "expired", "crowded_out"


def _rank(relevance: float | None) -> float:
    return -math.inf if relevance is None else math.inf if math.isnan(relevance) else relevance


@dataclass
class Window:
    """entries: by number, (id, relevance, inserted, ends); both heaps may name numbers that have gone."""

    capacity: int
    entries: dict[int, tuple] = field(default_factory=dict)
    count: int = 0

    def __post_init__(self):
        self.capacity = max(1, self.capacity)
        self._low = [(_rank(e[1]), e[2], n) for n, e in self.entries.items()]
        self._end = [(e[3], n) for n, e in self.entries.items()]
        heapq.heapify(self._low)
        heapq.heapify(self._end)

    def expire(self, now: float) -> list[tuple[str, str]]:
        """What is over at a time goes."""
        out = []
        while self._end and self._end[0][0] <= now:
            n = heapq.heappop(self._end)[1]
            if n in self.entries:
                out.append((self.entries.pop(n)[0], EXPIRED))
        return out

    def push(self, id_: str, relevance: float | None, now: float, ttl: float | None) -> list[tuple[str, str]]:
        """Hold an entry; the ids that leave for it, and why."""
        left = self.expire(now)
        while len(self.entries) >= self.capacity:
            n = heapq.heappop(self._low)[2]
            if n in self.entries:
                left.append((self.entries.pop(n)[0], CROWDED))
        ends = now + max(0.0, ttl or 0.0)
        self.entries[self.count] = (id_, relevance, now, ends)
        heapq.heappush(self._low, (_rank(relevance), now, self.count))
        heapq.heappush(self._end, (ends, self.count))
        self.count += 1
        if len(self._low) > 4 * self.capacity + 16 or len(self._end) > 4 * self.capacity + 16:
            self.__post_init__()  # without the numbers that have gone
        return left

    def live(self, now: float) -> list[str]:
        """Ids that hold at a time, in the order they came."""
        return [e[0] for _, e in sorted(self.entries.items()) if now < e[3]]


_ROW = "scope string, id string, context array<string>, left array<struct<id:string,why:string>>"


def _named(events: DataFrame, scope: str, id_: str, at: str, relevance: str, ttl: str | float) -> DataFrame:
    seconds = F.col(ttl) if isinstance(ttl, str) else F.lit(ttl)
    # pandas takes a null for a NaN: both get the place that they have
    known = F.col(relevance).cast("double")
    rank = F.when(known.isNull(), float("-inf")).when(F.isnan(known), float("inf")).otherwise(known)
    return events.select(F.col(scope).cast("string").alias("scope"), F.col(id_).cast("string").alias("id"), F.coalesce(F.col(at).cast("double"), F.lit(0.0)).alias("at"), rank.alias("relevance"), F.coalesce(seconds.cast("double"), F.lit(0.0)).alias("ttl"), F.col(id_).alias("place"))


def replay(events: DataFrame, scope: str, id_: str, at: str, relevance: str, capacity: int, ttl: str | float, final: bool = False) -> DataFrame:
    """``(scope, id, context, left)`` for each entry: what holds once it is pushed, and what left for it; ``final``: of each scope's last entry only. ttl: seconds, or the name of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, last = object(), None, None
        for b in batches:
            rows = []
            for s, i, t, r, e in zip(*(b.column(c).to_pylist() for c in ("scope", "id", "at", "relevance", "ttl")), strict=True):
                if s != key or window is None:
                    if final and last is not None:
                        rows.append(last)
                    key, window, last = s, Window(capacity), None
                gone = window.push(i, r, t, e)
                last = (s, i, window.live(t), [{"id": x, "why": w} for x, w in gone])
                if not final:
                    rows.append(last)
            yield _batch(rows)
        if final and last is not None:
            yield _batch([last])

    sorted_ = _named(events, scope, id_, at, relevance, ttl).repartition("scope").sortWithinPartitions("scope", "at", "place").drop("place")
    return sorted_.mapInArrow(run, _ROW)


_KINDS = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("id", pa.string()), ("why", pa.string())]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], names=["scope", "id", "context", "left"])


def stream(events: DataFrame, scope: str, id_: str, at: str, relevance: str, capacity: int, ttl: str | float) -> DataFrame:
    """The same on a stream. State is a scope's window: at most ``capacity`` entries, whatever has passed through it."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else ([], [], [], [], 0)
        entries = {n: (i, float(r), t, e) for n, (i, r, t, e) in enumerate(zip(*old[:4], strict=True))}
        window = Window(capacity, entries, len(entries))
        rows = pd.concat(list(parts)).sort_values(["at", "place"])
        out = []
        for r in rows.itertuples(index=False):
            gone = window.push(r.id, float(r.relevance), float(r.at), float(r.ttl))
            out.append((keys[0], r.id, window.live(float(r.at)), [{"id": x, "why": w} for x, w in gone]))
        kept = [e for _, e in sorted(window.entries.items())]
        held.update(([e[0] for e in kept], [e[1] for e in kept], [e[2] for e in kept], [e[3] for e in kept], window.count))
        yield pd.DataFrame(out, columns=["scope", "id", "context", "left"])

    state = "ids array<string>, relevance array<double>, inserted array<double>, ends array<double>, count bigint"
    return _named(events, scope, id_, at, relevance, ttl).groupBy("scope").applyInPandasWithState(run, _ROW, state, "append", GroupStateTimeout.NoTimeout)
