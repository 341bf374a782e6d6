"""Replicas that exchange what the other lacks: version vectors, deltas, and a relay with cursors.

A replica is a stored table of operations, each with the replica it comes from and its number
there, from 1 on without gaps. What a replica has is said by its version vector: for each
origin the number up to which nothing is missing, and the ranges beyond it. A delta is what a
vector lacks; taking one in adds only operations that aren't there yet, so deltas may be lost,
repeated, or come in any order, and replicas that have seen the same operations are equal.

A relay is a shared table that is only appended to. A push is one segment of it, and its
offset the number of segments so far; a pull reads the segments behind a cursor. What a replica
takes in and how far it has read are one version of its store, so a replica that dies reads
on where it was. Segments that all members have acknowledged may go.

Vectors are worked out by ranges of ``RANGE`` numbers, counted before anything is shuffled: an
origin with very many operations is as many rows as it has ranges.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from cairn.operators import syncing
from cairn.operators.relational import numbered
from cairn.plans.durable import Scratch
from cairn.sources.versions import Store

RANGE = 1 << 16
OPS, CURSORS = "ops", "cursors"
COLUMNS = "replica string, seq bigint, kind string, value string, tag string, observed_tag string"


class Transport(Protocol):
    """What carries deltas: anything that keeps the order in which segments came."""

    def push(self, topic: str, ops: DataFrame) -> int:
        """Append one segment; the offset after it."""

    def pull(self, topic: str, since: int) -> tuple[DataFrame | None, int]:
        """What came behind a cursor, and the cursor after it; None if nothing did."""


def vector(ops: DataFrame, size: int = RANGE) -> DataFrame:
    """``(replica, upto, beyond)``: of each origin the last number without a gap before it, and the ranges behind that gap.

    beyond: array of (from, to), in order. Repeated numbers count once, numbers below 1 not at all.
    """
    own = ops.where((F.col("seq") >= 1) & F.col("replica").isNotNull()).select("replica", "seq", F.floor((F.col("seq") - 1) / size).alias("at"))
    # an unbroken range is told by its count alone; only broken ones are looked into, each at most ``size`` numbers
    ranges = own.distinct().groupBy("replica", "at").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    whole = ranges.where(F.col("n") == F.col("b") - F.col("a") + 1).select("replica", "a", "b")
    broken = own.distinct().join(ranges.where(F.col("n") < F.col("b") - F.col("a") + 1).select("replica", "at"), ["replica", "at"], "left_semi")
    inside = Window.partitionBy("replica", "at").orderBy("seq")
    pieces = broken.withColumn("run", F.col("seq") - F.row_number().over(inside)).groupBy("replica", "at", "run").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).select("replica", "a", "b")
    along = Window.partitionBy("replica").orderBy("a")
    joined = whole.unionByName(pieces).withColumn("new", (F.col("a") != F.coalesce(F.lag("b").over(along), F.lit(-1)) + 1).cast("int"))
    joined = joined.withColumn("run", F.sum("new").over(along)).groupBy("replica", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    lists = joined.groupBy("replica").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))
    first = F.when(F.col("r")[0]["a"] == 1, F.col("r")[0]["b"]).otherwise(F.lit(0).cast("bigint"))
    return lists.select("replica", first.alias("upto"), F.filter("r", lambda x: x["a"] != 1).alias("beyond"))


def delta(ops: DataFrame, known: DataFrame) -> DataFrame:
    """The operations that a version vector lacks."""
    told = ops.join(known.select("replica", "upto", "beyond"), "replica", "left")
    has = F.exists("beyond", lambda r: F.col("seq").between(r["a"], r["b"]))
    return told.where(F.col("upto").isNull() | ((F.col("seq") > F.col("upto")) & ~has)).select(*ops.columns)


def lag(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(replica, ahead, behind)``: by origin, how many operations vector ``a`` has before its first gap that ``b`` hasn't, and the other way round."""
    both = a.select("replica", F.col("upto").alias("x")).join(b.select("replica", F.col("upto").alias("y")), "replica", "full")
    more = lambda x, y: F.greatest(F.coalesce(F.col(x), F.lit(0)) - F.coalesce(F.col(y), F.lit(0)), F.lit(0)).cast("bigint")
    return both.select("replica", more("x", "y").alias("ahead"), more("y", "x").alias("behind"))


class Relay:
    """A transport over a ``Store``: each topic is a table, each push a segment of it."""

    def __init__(self, store: Store):
        self.store = store

    def _segments(self, topic: str) -> tuple[int, list[str]]:
        """How many segments have gone, and the folders of those there are."""
        found = self.store.version()
        table = found.tables.get(topic) if found else None
        return (table.get("gone", 0), table["folders"]) if table else (0, [])

    def push(self, topic: str, ops: DataFrame) -> int:
        self.store.commit({topic: ops}, append=True)
        gone, folders = self._segments(topic)
        return gone + len(folders)

    def pull(self, topic: str, since: int) -> tuple[DataFrame | None, int]:
        gone, folders = self._segments(topic)
        if since < gone:
            raise LookupError(f"segments up to {gone} have gone: begin with a snapshot")
        new = folders[since - gone :]
        if not new:
            return None, max(since, gone + len(folders))
        return self.store.read_folders(topic, new), gone + len(folders)

    def trim(self, topic: str, acknowledged: list[int]) -> int:
        """Let go of the segments that all have read; how many are gone."""
        return self.store.forget_first(topic, min(acknowledged, default=0))


class Replica:
    """A stored set of operations with a name, and how far it has read of each topic."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def ops(self) -> DataFrame:
        if self.store.version() is None:
            return self.store.spark.createDataFrame([], COLUMNS)
        return self.store.read(OPS)

    def cursor(self, topic: str, way: str) -> int:
        """How far a topic was read (``pulled``), or how many own operations were sent and acknowledged (``pushed``)."""
        found = self.store.version()
        if found is None or CURSORS not in found.tables:
            return 0
        top = self.store.read(CURSORS).where((F.col("topic") == topic) & (F.col("way") == way)).agg(F.max("at")).first()[0]
        return top or 0

    def _mark(self, topic: str, way: str, at: int) -> DataFrame:
        return self.store.spark.createDataFrame([(topic, way, at)], "topic string, way string, at bigint")

    def last(self) -> int:
        """The number of the last own operation."""
        return self.ops().where(F.col("replica") == self.name).agg(F.max("seq")).first()[0] or 0

    def record(self, changes: DataFrame, order: str) -> int:
        """New operations of its own (kind, value, tag, observed_tag), numbered in an order behind those there are; how many."""
        start = self.last()
        named = changes.select("kind", "value", "tag", "observed_tag", F.col(order).alias("_by"))
        named = numbered(named, ["_by", "kind", "value", "tag"], Scratch(self.store.spark, "record"), "seq")
        new = named.select(F.lit(self.name).alias("replica"), (F.col("seq") + start).cast("bigint").alias("seq"), "kind", "value", "tag", "observed_tag")
        self.store.commit({OPS: new}, append=True)
        return self.last() - start

    def absorb(self, ops: DataFrame, topic: str | None = None, cursor: int = 0) -> int:
        """Take in what isn't there yet; how much that was. With a topic, its cursor is part of the same version."""
        have = self.ops().select("replica", "seq")
        fresh = ops.select(*[f.name for f in self.ops().schema]).dropDuplicates(["replica", "seq"]).join(have, ["replica", "seq"], "left_anti")
        before = self.ops().count()
        marks = {CURSORS: self._mark(topic, "pulled", cursor)} if topic else {}
        self.store.commit({OPS: fresh.select(*self.ops().columns), **marks}, append=True)
        return self.ops().count() - before

    def push(self, transport: Transport, topic: str) -> int:
        """Send own operations that weren't acknowledged; how many."""
        sent, last = self.cursor(topic, "pushed"), self.last()
        if last <= sent:
            return 0
        transport.push(topic, self.ops().where((F.col("replica") == self.name) & (F.col("seq") > sent)))
        # only now is it sure that they came through; if this is lost, they are sent again
        self.store.commit({CURSORS: self._mark(topic, "pushed", last)}, append=True)
        return last - sent

    def pull(self, transport: Transport, topic: str) -> int:
        """Take in what came since the last time; how much was new."""
        since = self.cursor(topic, "pulled")
        ops, at = transport.pull(topic, since)
        if ops is None or at <= since:
            return 0
        return self.absorb(ops, topic, at)

    def sync(self, transport: Transport, topic: str) -> tuple[int, int]:
        return self.push(transport, topic), self.pull(transport, topic)

    def vector(self) -> DataFrame:
        return vector(self.ops())

    def delta_for(self, known: DataFrame) -> DataFrame:
        return delta(self.ops(), known)

    def elements(self) -> DataFrame:
        """Live values: additions that no removal has observed."""
        return syncing.elements(self.ops())
