"""Operational analytics: latency histograms, outcomes by route, and caps on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Upper bounds of latency buckets in seconds.
BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0]


def bucket(seconds: Column) -> Column:
    """The number of the first bucket, from 0, whose bound isn't exceeded; the last is overflow."""
    out = F.lit(len(BOUNDS))
    for i in range(len(BOUNDS) - 1, -1, -1):
        out = F.when(seconds <= BOUNDS[i], i).otherwise(out)
    return out


def histogram(samples: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """``(keys, bucket, n)``, combined before the shuffle; adding up histograms is the same aggregate again."""
    return samples.groupBy(*keys, bucket(F.col(seconds)).alias("bucket")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, keys: list[str]) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cumulative", F.sum("n").over(run))


def quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A quantile by linear interpolation in its bucket; overflow counts as the last bound."""
    total = Window.partitionBy(*keys)
    steps = cumulative(hist, keys).withColumn("rank", F.lit(q) * F.sum("n").over(total)).where("cumulative >= rank")
    first = steps.groupBy(*keys).agg(F.min_by(F.struct("bucket", "n", "cumulative", "rank"), "bucket").alias("s"))
    bounds = F.array(*[F.lit(b) for b in [0.0, *BOUNDS]])
    low, high = F.get(bounds, F.col("s.bucket")), F.get(bounds, F.col("s.bucket") + 1)
    inside = (F.col("s.rank") - (F.col("s.cumulative") - F.col("s.n"))) / F.col("s.n")
    return first.select(*keys, F.when(F.col("s.bucket") == len(BOUNDS), F.lit(BOUNDS[-1])).otherwise(low + (high - low) * inside).alias("quantile"))


def route_class(route: Column) -> Column:
    """A route's class by whole segments of its path."""
    under = lambda base: (route == base) | route.startswith(base + "/")
    return F.when(under("/api/v1/query"), "query").when(under("/api/v1/evidence"), "evidence").when(under("/api/v1/synthesis"), "synthesis").otherwise("other")


def outcome(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status == 429, "throttled").otherwise("ok")


def capped_label(rows: DataFrame, label: str, at: list[str], cap: int) -> DataFrame:
    """Rows with ``overflow`` for all but the first ``cap`` labels that were seen. One row per label is ranked."""
    seen = rows.groupBy(label).agg(F.min(F.struct(*at)).alias("_first"))
    kept = seen.orderBy("_first", label).limit(cap).select(label).withColumn("_kept", F.lit(True))
    return rows.join(kept, label, "left").withColumn("label", F.when(F.col("_kept"), F.col(label)).otherwise("overflow")).drop("_kept")
