"""Change logs in many parts, as a stream source with offsets by part, and the pipeline behind it.

``spark.readStream.format("cairn_changelog").option("path", ...)`` reads a folder of logs, one JSON object
a line, to which others append and add. A batch's offsets are a place in each log, in bytes, behind
its last whole line. Between two offsets a log is cut into stretches of ``stretch`` bytes, each of
which is read by a task of its own: a stretch begins behind the first line end in it, and reads
its last line to the end. Nothing before an offset is read again, and no log is read whole.
``most`` bounds a batch's bytes for each log; a line longer than that is one batch.

Files are reached by Arrow's file systems, so a path may be in any store that these know.

The pipeline takes one batch of events at a time: changes of a document are merged, contents of
those that were created or updated are fetched, what has a body becomes evidence, what was
deleted becomes a tombstone, and each scope that got evidence gets one trigger of a synthesis. All that a
batch writes is one version of a store, which knows its batch: a batch that comes again
after a crash writes nothing.

A line that is no JSON object is an event without a kind, and counted as malformed. Null and
unknown kinds and events without a document are passed over and counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cairn.operators import callbacks
from cairn.operators.relational import latest
from cairn.sources.versions import Store

EVENT = "log string, place bigint, kind string, document_id string, scope_id string, occurred_at bigint, title string"
_FIELDS = [("kind", str), ("document_id", str), ("scope_id", str), ("occurred_at", int), ("title", str)]
_BLOCK = 1 << 16
_ROWS = 4096
_ARROW = pa.schema([("log", pa.string()), ("place", pa.int64()), *[(name, pa.string() if kind is str else pa.int64()) for name, kind in _FIELDS]])


class Stretch(InputPartition):
    def __init__(self, log: str, start: int, end: int, first: bool):
        self.log, self.start, self.end, self.first = log, start, end, first


def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """Bytes of each log of a folder, by its name."""
    system, root = _open(path)
    found = system.get_file_info(afs.FileSelector(root, recursive=False))
    return {f.base_name: f.size for f in found if f.type == afs.FileType.File and not f.base_name.startswith((".", "_"))}


def last_line_end(path: str, log: str, start: int, end: int) -> int:
    """The place behind the last line end in a part of a log; its start if there is none. Read backwards."""
    system, root = _open(path)
    with system.open_input_file(f"{root}/{log}") as f:
        at = end
        while at > start:
            begin = max(start, at - _BLOCK)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return start


def first_line_end(path: str, log: str, start: int, end: int) -> int:
    """The place behind the first line end from a place on; the start if there is none before the end."""
    system, root = _open(path)
    with system.open_input_file(f"{root}/{log}") as f:
        f.seek(start)
        at = start
        while at < end:
            block = f.read(min(_BLOCK, end - at))
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
            if not block:
                break
    return start


def lines(path: str, part: Stretch) -> Iterator[tuple[int, bytes]]:
    """Place and text of each line that begins in a stretch. A stretch that isn't a log's first begins behind a line end, or skips to one."""
    system, root = _open(path)
    with system.open_input_file(f"{root}/{part.log}") as f:
        at = part.start
        if not part.first:
            f.seek(at - 1)
            skipped = b"" if f.read(1) == b"\n" else None
            while skipped is None:
                block = f.read(_BLOCK)
                cut = block.find(b"\n")
                if cut >= 0 or not block:
                    at += cut + 1 if cut >= 0 else 0
                    skipped = b""
                else:
                    at += len(block)
        if at >= part.end:
            return
        f.seek(at)
        rest = b""
        while at < part.end:
            block = f.read(_BLOCK)
            if not block:
                return  # a line without an end isn't one yet
            whole = rest + block
            *found, rest = whole.split(b"\n")
            for line in found:
                if at >= part.end:
                    return
                yield at, line
                at += len(line) + 1


def rows(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    """The events of a stretch, in batches."""
    found = (event(part.log, place, line) for place, line in lines(path, part) if line.strip())
    while lot := list(islice(found, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def event(log: str, place: int, line: bytes) -> tuple:
    try:
        got = json.loads(line)
    except ValueError:
        got = None
    got = got if isinstance(got, dict) else {}
    values = [got.get(name) for name, _ in _FIELDS]
    return (log, place, *[v if isinstance(v, kind) and not isinstance(v, bool) else None for v, (_, kind) in zip(values, _FIELDS, strict=True)])


class ChangelogStream(DataSourceStreamReader):
    def __init__(self, path: str, stretch: int, most: int):
        self.path, self.stretch, self.most, self._at = path, stretch, most, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        at, out = self._at or {}, {}
        for log, size in _sizes(self.path).items():
            start = at.get(log, 0)
            end = last_line_end(self.path, log, start, min(size, start + self.most))
            out[log] = end if end > start or size <= start + self.most else first_line_end(self.path, log, start, size)
        self._at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self._at = dict(end)
        out = []
        for log, to in sorted(end.items()):
            begin = start.get(log, 0)
            out += [Stretch(log, a, min(a + self.stretch, to), a == begin) for a in range(begin, to, self.stretch)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition)

    def commit(self, end: dict) -> None:
        self._at = dict(end)


class ChangelogBatch(DataSourceReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch = path, stretch

    def partitions(self) -> list[Stretch]:
        ends = {log: last_line_end(self.path, log, 0, size) for log, size in _sizes(self.path).items()}
        return [Stretch(log, a, min(a + self.stretch, to), a == 0) for log, to in sorted(ends.items()) for a in range(0, to, self.stretch)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition)


class Changelog(DataSource):
    """Options: path; stretch, bytes of a task (64 MB); most, bytes of a log in a batch (no bound)."""

    @classmethod
    def name(cls) -> str:
        return "cairn_changelog"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> ChangelogStream:  # noqa: N802
        return ChangelogStream(self.options["path"], int(self.options.get("stretch", 1 << 26)), int(self.options.get("most", 1 << 62)))

    def reader(self, schema) -> ChangelogBatch:
        return ChangelogBatch(self.options["path"], int(self.options.get("stretch", 1 << 26)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Changelog)


# ---- the pipeline behind it

EVIDENCE, TOMBSTONES, TRIGGERS, RUNS = "evidence", "tombstones", "triggers", "runs"
TRIGGER = "connector_sync_completed"
KINDS = ["created", "updated", "deleted", "permission_changed"]
Fetch = Callable[[list[dict]], list[str | None]]


def ingest(store: Store, events: DataFrame, batch: int, fetch: Callable[[], Fetch], attempts: int = 3) -> bool:
    """Take one batch in; whether it was new. fetch: a factory of what gives a body, or None, for each of some documents."""
    done = store.version()
    if done is not None and RUNS in done.tables and not store.read(RUNS).where(F.col("batch") >= batch).isEmpty():
        return False
    # read once: logs are taken apart line by line
    events = store.scratch.keep(events.select("kind", "document_id", "scope_id", "occurred_at", "title", "log", "place"), f"events-{batch}")
    kept = events.where(F.col("kind").isin(KINDS) & F.col("document_id").isNotNull() & F.col("scope_id").isNotNull())
    body = kept.where("kind <> 'permission_changed'")
    last = latest(body.select("scope_id", "document_id", "kind", "title", F.coalesce("occurred_at", F.lit(0)).alias("occurred_at"), "log", "place"), ["scope_id", "document_id"], ["occurred_at", "log", "place"])
    asked = last.where("kind <> 'deleted'")
    got = callbacks.answered(asked, ["scope_id", "document_id", "title"], fetch, "body string", lambda row: None, attempts)
    # fetched once: a source may answer otherwise the next time
    got = store.scratch.keep(got, f"fetched-{batch}")
    new = got.where("body IS NOT NULL AND body <> ''").select("scope_id", "document_id", "title", "body", "occurred_at", F.lit(batch).cast("bigint").alias("batch"))
    gone = last.where("kind = 'deleted'").select("scope_id", "document_id", "occurred_at", F.lit(batch).cast("bigint").alias("batch"))
    asks = new.groupBy("scope_id").agg(F.count("*").alias("documents")).select("scope_id", F.lit(TRIGGER).alias("trigger"), "documents", F.lit(batch).cast("bigint").alias("batch"))
    counts = events.agg(F.count("*").alias("events"), F.count_if(F.col("kind").isNull()).alias("malformed"), F.count_if(~F.coalesce(F.col("kind").isin(KINDS) & F.col("document_id").isNotNull() & F.col("scope_id").isNotNull(), F.lit(False))).alias("passed_over"))
    told = got.agg(F.count("*").alias("fetched"), F.count_if(F.coalesce(F.col("body") != "", F.lit(False))).alias("ingested")).first()
    run = counts.select(F.lit(batch).cast("bigint").alias("batch"), "*", F.lit(told["fetched"]).cast("bigint").alias("fetched"), F.lit(told["ingested"]).cast("bigint").alias("ingested"), F.lit(told["fetched"] - told["ingested"]).cast("bigint").alias("skipped"))
    store.commit({EVIDENCE: new, TOMBSTONES: gone, TRIGGERS: asks, RUNS: run}, append=True, note=f"batch {batch}")
    store.scratch.drop(events)
    return True


def current(store: Store) -> DataFrame:
    """``(scope_id, document_id, title, body, occurred_at)``: the latest body of each document that wasn't deleted since."""
    rows = store.read(EVIDENCE).select("scope_id", "document_id", "occurred_at", "batch", "title", "body", F.lit(False).alias("gone"))
    ends = store.read(TOMBSTONES).select("scope_id", "document_id", "occurred_at", "batch", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body"), F.lit(True).alias("gone"))
    top = latest(rows.unionByName(ends), ["scope_id", "document_id"], ["occurred_at", "batch", "gone"])
    return top.where("NOT gone").select("scope_id", "document_id", "title", "body", "occurred_at")


def run(stream: DataFrame, store: Store, fetch: Callable[[], Fetch], checkpoint: str, attempts: int = 3):
    """Start the pipeline on all there is; the checkpoint and the store make it resumable."""
    return stream.writeStream.foreachBatch(lambda frame, number: ingest(store, frame, number, fetch, attempts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
