"""Where a caller's own code plugs in: models, extractors, chunkers, summarisers, inference.

Everything a plug-in sees comes in Arrow batches on the executors; a plug-in is built once
per task by a factory, so that models needn't be sent with the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf, udtf

from cairn.functions.text import once

EmbedBatch = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> EmbedBatch:
    """A model that needs no files: signed hashed words, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(texts: DataFrame, text: str, factory: Callable[[], EmbedBatch], gate: Column | None = None) -> DataFrame:
    """Adds ``embedding``; rows that the gate leaves out get null and aren't sent to the model."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for p in parts:
            yield pd.Series(list(model(p.fillna("").tolist())), index=p.index)

    open_ = F.col(text).rlike(r"\p{L}") if gate is None else gate
    asked = texts.where(open_).withColumn("embedding", run(F.col(text)))
    return asked.unionByName(texts.where(~F.coalesce(open_, F.lit(False))).withColumn("embedding", F.lit(None).cast("array<float>")))


def embed_contents(evidence: DataFrame, factory: Callable[[], EmbedBatch]) -> DataFrame:
    """Each distinct content once, and back to all rows that have it."""
    once = evidence.groupBy("content_hash").agg(F.min("body").alias("body"))
    return evidence.join(embed(once, "body", factory).select("content_hash", "embedding"), "content_hash", "left")


def classifier(factory: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """An importance classifier in place of the built-in expression."""

    @pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for p in parts:
            yield pd.Series(model(p.fillna("").tolist()), index=p.index)

    return run


def extractor(fn: Callable[[str], list[tuple[str, str, float]]]):
    """A table function ``(text) -> (kind, content, confidence)``, one row for each observation."""

    @udtf(returnType="kind string, content string, confidence double")
    class Extract:
        def eval(self, text: str):
            yield from fn(text or "")

    return Extract


def chunker(fn: Callable[[str], list[str]]):
    """A table function ``(text) -> (place, chunk)``."""

    @udtf(returnType="place int, chunk string")
    class Chunk:
        def eval(self, text: str):
            yield from enumerate(fn(text or ""))

    return Chunk


def refine(entities: DataFrame, factory: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], least: float = 0.7) -> DataFrame:
    """Entities with the type a model gives them, where it is sure enough."""

    @pandas_udf("kind string, confidence double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for p in parts:
            yield pd.DataFrame(model(p.fillna("").tolist()), columns=["kind", "confidence"], index=p.index)

    seen = entities.withColumn("_seen", run(F.col("content")))
    return seen.withColumn("kind", F.when(F.col("_seen.confidence") >= least, F.col("_seen.kind")).otherwise(F.col("kind"))).drop("_seen")


def summarise(sessions: DataFrame, fn: Callable[[list[str]], str]) -> DataFrame:
    """``(scope_id, session, summary)`` of observations with their session; one session at a time."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scope_id": [keys[0]], "session": [keys[1]], "summary": [fn(rows.sort_values(["occurred_at", "id"])["body"].tolist())]})

    return sessions.groupBy("scope_id", "session").applyInPandas(run, "scope_id string, session bigint, summary string")


def infer(prompts: DataFrame, prompt: str, factory: Callable[[], Callable[[str], str]], fallback: str = "") -> DataFrame:
    """Adds ``answer`` and ``failed``; a call that fails gets the fallback, and the row stays."""

    @pandas_udf("answer string, failed boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = factory()
        for p in parts:
            rows = []
            for text in p.fillna(""):
                try:
                    rows.append((client(text), False))
                except Exception:  # whatever a client raises, the other rows go on
                    rows.append((fallback, True))
            yield pd.DataFrame(rows, columns=["answer", "failed"], index=p.index)

    return prompts.withColumn("_a", run(F.col(prompt))).select("*", "_a.answer", "_a.failed").drop("_a")


def evaluate(produced: DataFrame, expected: DataFrame) -> DataFrame:
    """``(kind, tp, fp, fn)``: in each case, an expected item is matched by at most one produced item of its kind that contains it, in upper or lower case.

    produced, expected: (case_id, kind, content). Items are matched one by one in order of
    content, so a case's items of a kind are one group; cases are small. Only what contains an expected item is matched.
    """
    of = lambda rows, made: rows.select("case_id", "kind", F.when(F.lit(made), F.col("content")).alias("made"), F.when(F.lit(not made), F.col("content")).alias("want"))
    groups = of(produced, True).unionByName(of(expected, False)).groupBy("case_id", "kind").agg(F.collect_list("made").alias("made"), F.array_sort(F.collect_list("want")).alias("want"))
    low = groups.select("kind", F.size("made").alias("n"), F.size("want").alias("wants"), F.transform("want", F.lower).alias("want"), F.when(F.size("want") > 0, F.col("made")).alias("made"))
    near = F.filter(F.transform(F.array_sort("made"), F.lower), lambda x: F.exists("want", lambda w: x.contains(w)))
    none = F.struct(F.array().cast("array<string>").alias("left"), F.lit(0).alias("tp"))

    def match(state, want):
        hit = lambda i: F.when(i > 0, F.struct(F.concat(F.slice(state["left"], F.lit(1), (i - 1).cast("int")), F.slice(state["left"], (i + 1).cast("int"), F.size(state["left"]))).alias("left"), (state["tp"] + 1).alias("tp"))).otherwise(state)
        return once(F.array_position(F.transform(state["left"], lambda x: x.contains(want)), True), hit)

    start = F.struct(F.coalesce(near, none["left"]).alias("left"), none["tp"].alias("tp"))
    each = low.select("kind", "n", "wants", F.aggregate("want", start, match)["tp"].alias("tp"))
    return each.groupBy("kind").agg(F.sum("tp").alias("tp"), F.sum(F.col("n") - F.col("tp")).alias("fp"), F.sum(F.col("wants") - F.col("tp")).alias("fn"))
