"""Hybrid retrieval: lexical, recency and vector candidates in one ranking, and clusters of equal contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.relational import top_per

WEIGHTS = {"fts": 0.6, "recency": 0.3, "vector": 0.1}
RECENCY_HALF_LIFE = 7 * 86_400


def recency(as_of: int, created_at: Column, half_life: float = RECENCY_HALF_LIFE, ahead: bool = False) -> Column:
    """1 now, half of it after each half-life. What is dated after ``as_of`` counts as now; ahead: it goes on growing beyond 1."""
    age = as_of - created_at
    return F.pow(F.lit(2.0), -(age if ahead else F.greatest(age, F.lit(0))) / half_life)


def fts_projection(score: Column, literal: bool = False) -> Column:
    """A lexical score between 0 and 1: better hits are higher. literal: the inverse form that some clients expect."""
    return 1 / (1 + score) if literal else score / (1 + score)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if their lengths differ or one is zero."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(F.least(F.greatest(dot / norm, F.lit(-1.0)), F.lit(1.0)))


def sim_to_score(similarity: Column) -> Column:
    return F.least(F.greatest((similarity + 1) / 2, F.lit(0.0)), F.lit(1.0))


def hybrid(lexical: DataFrame, newest: DataFrame, vectors: DataFrame, times: DataFrame, as_of: int, weights: dict[str, float] | None = None, ahead: bool = False) -> DataFrame:
    """``(doc, fts, recency, vector, score)`` of all candidates.

    lexical: (doc, score); newest: (doc); vectors: (doc, vector); times: (doc, created_at).
    Candidates are the union of the first two; vectors only score them. ahead: as in ``recency``.
    """
    w = weights or WEIGHTS
    hits = lexical.select("doc", fts_projection(F.col("score")).alias("fts"))
    found = hits.join(newest.select("doc").distinct(), "doc", "full")
    scored = found.join(times, "doc", "left").join(vectors, "doc", "left").select("doc", F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce(recency(as_of, F.col("created_at"), ahead=ahead), F.lit(0.0)).alias("recency"), F.coalesce("vector", F.lit(0.0)).alias("vector"))
    return scored.withColumn("score", w["fts"] * F.col("fts") + w["recency"] * F.col("recency") + w["vector"] * F.col("vector"))


def widen(limit: int) -> int:
    return max(4 * limit, 16)


def cluster(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits of equal content as one: best member, members in order, number of sources.

    hits: (doc, score); meta: (doc, content_hash, source_ref).
    """
    return (
        hits.join(meta, "doc", "left").groupBy(F.coalesce("content_hash", F.col("doc").cast("string")).alias("cluster"))
        .agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("best"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_list("doc")), ",").alias("members"), F.countDistinct("source_ref").alias("sources"))
    )


def best(hits: DataFrame, k: int) -> DataFrame:
    return top_per(hits, [], [F.desc("score"), F.asc("doc")], k)


def rank_score(hits: DataFrame, k: int) -> DataFrame:
    """The first k with ``1 - place / n`` as the score."""
    ranked = top_per(hits, [], [F.desc("score"), F.asc("doc")], k, rank="place")
    return ranked.select("doc", (1 - (F.col("place") - 1) / F.max("place").over(Window.partitionBy())).alias("rank_score"))  # k rows
