"""Change events from outside: webhook bodies, a readable source with a cursor, and upserts by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader

from cairn.operators.relational import latest
from cairn.operators.syncing import after_watermark

KINDS = ["created", "updated", "deleted", "permission_changed"]
EVENT = "kind string, document_id string, occurred_at bigint, title string"


def parse_webhooks(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Typed events, and what is wrong with a body that isn't one; nothing is dropped."""
    parsed = bodies.withColumn("event", F.from_json(F.col(body), EVENT))
    wrong = F.when(F.col("event").isNull() | F.col("event.kind").isNull(), "malformed").when(~F.col("event.kind").isin(KINDS), "unknown_kind").when(F.col("event.document_id").isNull(), "no_document")
    return parsed.select(*bodies.columns, "event.*", wrong.alias("quarantine"))


class ChangeReader(SimpleDataSourceStreamReader):
    """Reads what ``pages`` gives: a function from a cursor to (events, next cursor)."""

    def __init__(self, path: str, page: int):
        self.path, self.page = path, page

    def _lines(self) -> list[str]:
        with open(self.path) as f:
            return f.read().splitlines()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines = self._lines()[start["line"] : start["line"] + self.page]
        return iter([self._row(x) for x in lines]), {"line": start["line"] + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([self._row(x) for x in self._lines()[start["line"] : end["line"]]])

    @staticmethod
    def _row(line: str) -> tuple:
        e = json.loads(line)
        return e.get("kind"), e.get("document_id"), e.get("occurred_at"), e.get("title")


class ChangeSource(DataSource):
    """``spark.readStream.format("cairn_changes").option("path", ...)``: a log of change events, one JSON object a line."""

    @classmethod
    def name(cls) -> str:
        return "cairn_changes"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options["path"], int(self.options.get("page", "1000")))

    def reader(self, schema):
        outer = self

        from pyspark.sql.datasource import DataSourceReader

        class Batch(DataSourceReader):
            def partitions(self):
                return [InputPartition(0)]

            def read(self, partition):
                return iter([ChangeReader._row(x) for x in ChangeReader(outer.options["path"], 0)._lines()])

        return Batch()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeSource)


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after a batch of changes: the latest of each counts, deletions take it away."""
    both = current.select("document_id", "occurred_at", "title", F.lit("updated").alias("kind")).unionByName(changes.select("document_id", "occurred_at", "title", "kind"))
    return latest(both, ["document_id"], ["occurred_at", "kind"]).where("kind <> 'deleted'").select("document_id", "occurred_at", "title")


def sync(stream: DataFrame, marks: Callable[[], DataFrame] | None, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the pipeline: each micro-batch passes the cursor, loses repeats and is written. The checkpoint makes it resumable."""

    def batch(frame: DataFrame, number: int) -> None:
        fresh = frame.dropDuplicates(["document_id", "occurred_at", "kind"])
        if marks is not None:
            fresh = after_watermark(fresh, marks(), ["document_id"], "occurred_at", "kind")
        write(fresh, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exactly_once(stream: DataFrame, id_: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each id once, with state for only as long as an event may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])
