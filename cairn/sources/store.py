"""Tables that are written: snapshots, reports, configurations and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def snapshot(frames: dict[str, DataFrame], path: str) -> None:
    """Write tables below a path; each is whole when its ``_SUCCESS`` is there."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_evidence(evidence: DataFrame, path: str, buckets: int = 64) -> None:
    """Append evidence, laid out by scope bucket: a scope's reads touch one folder."""
    evidence.withColumn("scope_bucket", F.pmod(F.xxhash64("scope_id"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("scope_bucket").parquet(path)


def read_scope(spark: SparkSession, path: str, scope: str, buckets: int = 64) -> DataFrame:
    """One scope's evidence: the bucket prunes folders, the scope reaches the scan."""
    bucket = F.pmod(F.xxhash64(F.lit(scope)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("scope_bucket") == bucket) & (F.col("scope_id") == scope))


def write_report(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def blob(json: Column, schema: str) -> Column:
    """A JSON blob as typed rows; what can't be read is null."""
    return F.from_json(json, schema)


BUNDLE = "recap string, decisions array<string>, open_questions array<string>, active_tasks array<string>"


def parse_bundle(raw: Column) -> Column:
    """``(bundle, salvaged)`` of a model's output: the JSON in it, or only its recap if the rest was cut off."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = F.from_json(body, BUNDLE)
    recap = F.regexp_extract(raw, r'(?s)"recap"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    none = F.array().cast("array<string>")
    saved = F.when(recap != "", F.struct(recap.alias("recap"), none.alias("decisions"), none.alias("open_questions"), none.alias("active_tasks")))
    ok = whole.isNotNull() & whole["recap"].isNotNull()
    return F.struct(F.when(ok, whole).otherwise(saved).alias("bundle"), (~ok & (recap != "")).alias("salvaged"))
