"""Synthesis windows, quality of recaps, and the election of a device that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.relational import top_per

# Legal changes of a window's status.
STATUS = {"in_progress": ["pending"], "complete": ["in_progress"], "failed": ["pending", "in_progress"], "pending": ["complete"]}


def rolling(rows: DataFrame, at: str, as_of: int, seconds: int) -> DataFrame:
    """Rows of the last seconds; the filter reaches the scan."""
    return rows.where(F.col(at).between(as_of - seconds, as_of))


def in_windows(rows: DataFrame, windows: DataFrame, at: str, width: int) -> DataFrame:
    """Rows with the windows [start, end) of their scope that hold them.

    Windows are cut into slices of ``width`` seconds, and rows meet them by scope and slice:
    an equi-join, with a comparison only between rows and windows of one slice.
    """
    cut = windows.withColumn("_slice", F.explode(F.sequence(F.expr(f"window_start div {width}"), F.expr(f"(window_end - 1) div {width}"))))
    return rows.withColumn("_slice", F.expr(f"{at} div {width}")).join(cut, ["scope_id", "_slice"]).where((F.col(at) >= F.col("window_start")) & (F.col(at) < F.col("window_end"))).drop("_slice")


def fail_stuck(windows: DataFrame, as_of: int, threshold: int) -> DataFrame:
    return windows.withColumn("status", F.when((F.col("status") == "pending") & (as_of - F.col("window_end") > threshold), "failed").otherwise(F.col("status")))


def newest_complete(windows: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    return top_per(windows.where("status = 'complete'"), keys, [F.desc("window_end"), F.desc("id")], n)


def change(status: Column, to: str) -> Column:
    """The status after a change; one that isn't legal changes nothing."""
    return F.when(status.isin(STATUS[to]), to).otherwise(status)


def eligible(as_of: int, ttl: int = 300, floor: int = 20) -> Column:
    return F.col("online") & ~F.col("stepped_down") & (F.col("battery") >= floor) & (F.col("tier") >= 1) & (as_of - F.col("heartbeat_at") < ttl)


def elect(devices: DataFrame, as_of: int) -> DataFrame:
    """The device of each scope that writes recaps: best tier, then latest heartbeat, battery and id."""
    return devices.where(eligible(as_of)).groupBy("scope_id").agg(F.max_by("id", F.struct("tier", "heartbeat_at", "battery", "id")).alias("elected"))


def bundle_score(recap: Column, salient: Column, structured: Column, ungrounded: Column, openers: list[str], shortest: int = 40, least_terms: int = 5, coverage: float = 0.2) -> Column:
    """The quality of a recap: length, structure and covered terms, less penalties."""
    low = F.lower(F.trim(recap))
    covered = F.size(F.filter(salient, lambda t: low.contains(t)))
    opened = low.rlike("^(" + "|".join(openers) + ")") if openers else F.lit(False)
    score = F.least(F.length(F.trim(recap)), F.lit(280)) + F.least(structured, F.lit(1000)) * 8 + F.least(covered, F.lit(1000)) * 12
    low_coverage = (F.size(salient) >= least_terms) & (covered / F.size(salient) < coverage)
    return score - F.when(opened, 500).otherwise(0) - F.when(F.length(F.trim(recap)) < shortest, 200).otherwise(0) - F.when(low_coverage, 50).otherwise(0) - F.least(ungrounded, F.lit(1000)) * 20


def term_coverage(recap: Column, expected: Column) -> Column:
    """The share of expected terms in a recap; 1 if none is expected."""
    hits = F.size(F.filter(expected, lambda t: F.contains(F.lower(recap), F.lower(t))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def heartbeat(devices: DataFrame, pings: DataFrame) -> DataFrame:
    """Devices ``(id, heartbeat_at, stepped_down)`` after pings ``(id, at)``: a ping refreshes and clears a step-down; unknown devices are ignored."""
    newest = pings.groupBy("id").agg(F.max("at").alias("at"))
    joined = devices.join(newest, "id", "left")
    return joined.select("id", F.greatest("heartbeat_at", "at").alias("heartbeat_at"), (F.col("stepped_down") & F.col("at").isNull()).alias("stepped_down"))


def step_down(devices: DataFrame, leaving: DataFrame) -> DataFrame:
    """Devices ``(id, stepped_down)`` after those of ``leaving`` have stepped down; unknown devices are ignored."""
    gone = leaving.select("id").distinct().withColumn("_gone", F.lit(True))
    return devices.join(gone, "id", "left").select("id", (F.col("stepped_down") | F.coalesce("_gone", F.lit(False))).alias("stepped_down"))


def adaptive_budget(rows: Column) -> Column:
    """Tokens for a recap of so many rows."""
    return F.least(F.greatest(640 + 48 * rows, F.lit(640)), F.lit(1024)).cast("bigint")
