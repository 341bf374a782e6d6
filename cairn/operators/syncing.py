"""Merging replicas: operation logs, add-wins sets, watermarks and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.relational import latest


def merge_logs(*logs: DataFrame) -> DataFrame:
    """Operations of several logs, each once by replica and number."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(["replica", "seq"])


def live_adds(log: DataFrame) -> DataFrame:
    """``(value, tag)`` of additions that no removal has observed. The order of operations doesn't matter."""
    adds = log.where("kind = 'add'").select("value", "tag").distinct()
    gone = log.where("kind = 'remove' AND observed_tag IS NOT NULL").select(F.col("observed_tag").alias("tag")).distinct()
    return adds.join(gone, "tag", "left_anti").select("value", "tag")


def elements(log: DataFrame) -> DataFrame:
    return live_adds(log).select("value").distinct()


def entries(log: DataFrame) -> DataFrame:
    """Live values with the number of their tags and the least one."""
    return live_adds(log).groupBy("value").agg(F.count("*").alias("tags"), F.min("tag").alias("first_tag"))


def compact(log: DataFrame) -> DataFrame:
    """The operations that a compacted log keeps: live additions and supersessions."""
    kept = live_adds(log).select("tag").distinct()
    return log.where("kind = 'add'").join(kept, "tag", "left_semi").select("replica", "seq", "kind", "value", "tag").union(log.where("kind = 'supersede'").select("replica", "seq", "kind", "value", "tag"))


def delta_since(log: DataFrame, replica: int, seq: int) -> DataFrame:
    """What another replica may lack: all operations of others, and own ones after a number."""
    return log.where((F.col("replica") != replica) | (F.col("seq") > seq))


def watermark(events: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """The high-water mark of each key: the latest time, and the ids that have it."""
    top = events.groupBy(*keys).agg(F.max(at).alias("mark"))
    at_mark = events.join(top, keys).where(F.col(at) == F.col("mark"))
    return at_mark.groupBy(*keys, "mark").agg(F.array_sort(F.collect_set(id_)).alias("boundary"))


def after_watermark(events: DataFrame, marks: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """Events that a cursor lets through: later ones, and those at the mark that weren't seen."""
    seen = F.coalesce(F.array_contains("boundary", F.col(id_)), F.lit(False))
    return events.join(marks, keys, "left").where(F.col("mark").isNull() | (F.col(at) > F.col("mark")) | ((F.col(at) == F.col("mark")) & ~seen)).drop("mark", "boundary")


def cursor_text(mark: Column, boundary: Column) -> Column:
    return F.concat_ws("|", mark.cast("string"), F.array_join(boundary.cast("array<string>"), ","))


def cursor_parse(cursor: Column) -> Column:
    return F.struct(F.substring_index(cursor, "|", 1).cast("bigint").alias("mark"), F.size(F.split(F.substring_index(cursor, "|", -1), ",")).alias("ids"))


def current_documents(events: DataFrame) -> DataFrame:
    """The latest change of each document, without those it deleted."""
    return latest(events, ["document_id"], ["occurred_at", "event_id"]).where("kind <> 'deleted'")


def needs_compaction(ops: Column, tombstones: Column, size: Column, grown: Column) -> Column:
    """A log that has grown is compacted if over 0.3 of it are tombstones, or it is larger than 4 MiB."""
    return (grown > 10_000) & ((tombstones / ops > 0.3) | (size > 4 * 1024 * 1024))
