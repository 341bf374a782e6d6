"""The shapes that most of the store's operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.plans.durable import Scratch

#: Bytes of texts for one task.
SHARE = 16 << 20


def where_equal(frame: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the values; an equality filter reaches the scan."""
    for name, value in values.items():
        frame = frame.where(F.col(name) == F.lit(value))
    return frame


def top_per(frame: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Without a key it is a plain top-n, which needs no sort of everything."""
    if not keys:
        best = frame.orderBy(*order).limit(n)
        return best if rank is None else best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    ranked = frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return ranked.withColumnRenamed("_n", rank) if rank else ranked.drop("_n")


def latest(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by``: an aggregate, combined before the shuffle."""
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*frame.columns)


def earliest(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the least ``by``."""
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*frame.columns)


def without(frame: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in ``gone``."""
    return frame.join(gone.select(*keys).distinct(), keys, "left_anti")


def only(frame: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``kept``."""
    return frame.join(kept.select(*keys).distinct(), keys, "left_semi")


def page(frame: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered table."""
    return frame.orderBy(*order).offset(offset).limit(limit)


def within_cap(frame: DataFrame, keys: list[str], keep_first: list[Column], size: str, cap: int) -> DataFrame:
    """Of each key, the rows whose running total of ``size``, in order of keeping, stays within the cap."""
    run = Window.partitionBy(*keys).orderBy(*keep_first).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("_sum", F.sum(size).over(run)).where(F.col("_sum") <= cap).drop("_sum")


def numbered(frame: DataFrame, order: list[str], scratch: Scratch, name: str = "sequence") -> DataFrame:
    """Rows with gapless numbers from 1 in the order given, without bringing all rows together.

    Ranges of the order are numbered side by side, each from the count of rows in those
    before it; only the counts, a row for each range, pass through one window.
    """
    ranged = scratch.keep(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", inside).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")


def count_where(name: str, condition: Column) -> Column:
    """A counter of the rows that meet a condition."""
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def bytes_of(frame: DataFrame) -> int:
    """What Spark takes a frame to be before it runs: for a table, its files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(frame: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows for work that is dear for each of them: dealt out by a hash to all cores, in shares of about so many bytes.

    A file's row group is read by one task, however large it is, so a table in few of them would be
    worked on by few cores. A hash needs no sort, and a repeated task deals the same rows the same way.
    With a share of 0 they stay where they are read.
    """
    if not share:
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(max(cores, min(bytes_of(frame) // share, 64 * cores)), *frame.columns)
