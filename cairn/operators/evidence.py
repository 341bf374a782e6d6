"""The append-only evidence store: reads, writes, routing, references, noise buffer and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.relational import earliest, latest, only, top_per, within_cap, without

INLINE_BYTES = 512
NOISE, USEFUL, IMPORTANT, CRITICAL = range(4)


def storage_route(size: Column, importance: Column, inline_bytes: int = INLINE_BYTES) -> Column:
    """Noise goes to the ring buffer, small bodies are kept inline, others in the body table."""
    return F.when(importance == NOISE, "ring_buffer").when(size <= inline_bytes, "inline").otherwise("body_table")


def ingest(messages: DataFrame) -> DataFrame:
    """Messages as evidence rows with their route."""
    return messages.withColumn("storage_path", storage_route(F.col("size_bytes"), F.col("importance")))


def body_store(evidence: DataFrame) -> DataFrame:
    """Bodies once per content, with the number of rows that refer to them."""
    routed = ingest(evidence).where("storage_path = 'body_table'")
    return routed.groupBy("content_hash").agg(F.min("body").alias("body"), F.count("*").alias("ref_count"))


def key_wraps(evidence: DataFrame) -> DataFrame:
    """Which scopes hold which bodies of the body table."""
    return ingest(evidence).where("storage_path = 'body_table'").select("content_hash", "scope_id").distinct()


def read_body(evidence: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each row's body: the inline one, or that of its content hash."""
    routed = ingest(evidence).withColumn("inline_body", F.when(F.col("storage_path") == "inline", F.col("body"))).drop("body")
    return routed.join(bodies.select("content_hash", F.col("body").alias("stored")), "content_hash", "left").withColumn("body", F.when(F.col("storage_path") != "ring_buffer", F.coalesce("inline_body", "stored")))


def recent(evidence: DataFrame, n: int, scope: str | None = None) -> DataFrame:
    """The newest rows of a scope, or of each scope."""
    order = [F.desc("created_at"), F.desc("evidence_id")]
    if scope is not None:
        return top_per(evidence.where(F.col("scope_id") == scope), [], order, n)
    return top_per(evidence, ["scope_id"], order, n)


def references_of(refs: DataFrame, evidence_id: int) -> DataFrame:
    return refs.where(F.col("evidence_id") == evidence_id).select("ref_key", "ref_value")


def find_by_reference(refs: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a reference, oldest first."""
    return refs.where((F.col("ref_key") == key) & (F.col("ref_value") == value)).orderBy("created_at", "evidence_id")


def cross_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of the given rows, the others that share a reference. Only the given rows' references drive the join.

    Rows know all their references, and a pair is made at the least one that both have: it comes once, so
    pairs, which may be far more than rows, go out as they are made, and are neither kept nor sorted.
    """
    known = refs.where("evidence_id IS NOT NULL AND ref_key IS NOT NULL AND ref_value IS NOT NULL").groupBy("evidence_id").agg(F.collect_set(F.struct("ref_key", "ref_value")).alias("known"))
    each = known.select("evidence_id", "known", F.explode("known").alias("ref")).select("evidence_id", "known", "ref.ref_key", "ref.ref_value")
    own = each.join(ids.select("evidence_id").distinct(), "evidence_id", "left_semi").select(F.col("evidence_id").alias("of"), F.col("known").alias("of_known"), "ref_key", "ref_value")
    first = F.array_min(F.array_intersect("of_known", "known"))
    pairs = own.join(each, ["ref_key", "ref_value"]).where("of <> evidence_id")
    return pairs.where(first == F.struct("ref_key", "ref_value")).select("of", "evidence_id")


def add_references(refs: DataFrame, new: DataFrame) -> DataFrame:
    """References with new ones; what is there already stays as it is."""
    return refs.select("evidence_id", "ref_key", "ref_value").union(new.select("evidence_id", "ref_key", "ref_value")).distinct()


def effective_importance(evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each row's class, after the latest reclassification."""
    last = latest(overrides.select("evidence_id", "new_importance", "overridden_at"), ["evidence_id"], ["overridden_at", "new_importance"])
    return evidence.join(last, "evidence_id", "left").withColumn("effective", F.coalesce("new_importance", "importance"))


def ring_evict(ring: DataFrame, cap: int) -> DataFrame:
    """What stays in each scope's noise buffer: lowest priority, then least recently used, goes first."""
    return within_cap(ring, ["scope_id"], [F.desc("priority"), F.desc("last_accessed_at"), F.desc("id")], "payload_size", cap)


def ring_promote(ring: DataFrame, evidence: DataFrame, ids: list[int], importance: int) -> tuple[DataFrame, DataFrame]:
    """The buffer without the promoted entries, and these as evidence ids with their class."""
    chosen = F.col("id").isin(ids)
    return ring.where(~chosen), ring.where(chosen).select(F.col("id").alias("evidence_id"), "scope_id", F.lit(importance).alias("importance"))


def ring_touch(ring: DataFrame, ids: list[int], at: int) -> DataFrame:
    return ring.withColumn("last_accessed_at", F.when(F.col("id").isin(ids), F.lit(at)).otherwise(F.col("last_accessed_at")))


def ring_priority(ring: DataFrame, ids: list[int], priority: int) -> DataFrame:
    return ring.withColumn("priority", F.when(F.col("id").isin(ids), F.lit(priority)).otherwise(F.col("priority")))


def forget_scopes(frame: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of scopes that weren't forgotten."""
    return without(frame, tombstones, ["scope_id"])


def record_tombstones(tombstones: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("scope_id",)) -> DataFrame:
    """Insert or ignore: the first time of a key counts."""
    own = [*keys, "forgotten_at"]
    return tombstones.select(*own).union(new.select(*own)).groupBy(*keys).agg(F.min("forgotten_at").alias("forgotten_at"))


def purge_wraps(wraps: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wraps without the scopes, and the bodies that lose their last wrap."""
    left = without(wraps, scopes, ["scope_id"])
    return left, without(wraps.select("content_hash").distinct(), left, ["content_hash"])


def orphans(bodies: DataFrame, wraps: DataFrame) -> DataFrame:
    """Bodies that no scope holds."""
    return without(bodies, wraps, ["content_hash"])


def embedding_copies(vectors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Vectors for rows without one whose content has one under the same model; the lowest id's vector counts."""
    known = vectors.groupBy("content_hash", "model_tag").agg(F.min_by("embedding", "evidence_id").alias("embedding"), F.min("evidence_id").alias("copied_from"))
    missing = evidence.select("evidence_id", "content_hash").join(vectors.select("evidence_id"), "evidence_id", "left_anti")
    return missing.join(known, "content_hash")


def scopes_of(*tables: DataFrame) -> DataFrame:
    """The distinct scopes of several tables; each is made distinct before the union."""
    out = None
    for t in tables:
        own = t.select(F.col("scope_id").cast("string").alias("scope_id")).distinct()
        out = own if out is None else out.union(own)
    return out.distinct()


def first_of(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return earliest(frame, keys, by)


def keep_scopes(frame: DataFrame, scopes: DataFrame) -> DataFrame:
    return only(frame, scopes, ["scope_id"])
