"""Permissions, export policy, proposals and access-list changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.plans.durable import Scratch

# Ranks of sensitivity, and which relation implies which.
RANK = {"noise": 0, "useful": 1, "important": 2, "critical": 3}
IMPLIES = {"owner": ["owner", "admin", "editor", "member", "viewer"], "admin": ["admin", "editor", "member", "viewer"], "editor": ["editor", "viewer"], "member": ["member", "viewer"], "viewer": ["viewer"], "synthesizer": ["synthesizer"], "proposer": ["proposer"]}


def rank(sensitivity: Column) -> Column:
    out = F.lit(0)
    for name, value in RANK.items():
        out = F.when(sensitivity == name, value).otherwise(out)
    return out


def covering(wanted: str) -> list[str]:
    """The relations that give the wanted one."""
    return sorted(held for held, given in IMPLIES.items() if wanted in given)


def export_decision(concepts: DataFrame, as_of: int, ceiling: str = "important", scopes: list[str] | None = None, provenance: bool = True, window: int | None = None, cap: int | None = None) -> DataFrame:
    """Concepts with the first reason against their export, or ``approved``; the cap counts what passed all else, in order of position.

    The cap needs no running count over all rows: the position of the last one that fits is
    found by a top-n of what passed, and becomes part of the plan.
    """
    reason = F.when(F.col("expires_at") <= as_of, "expired").when(rank(F.col("sensitivity")) > RANK[ceiling], "sensitivity")
    if scopes is not None:
        reason = reason.when(~F.col("scope_id").isin(scopes), "scope")
    if provenance:
        reason = reason.when(F.col("provenance").isNull(), "provenance")
    if window is not None:
        reason = reason.when(as_of - F.col("approved_at") > window, "time_window")
    judged = concepts.withColumn("reason", reason)
    if cap is not None:
        last = judged.where("reason IS NULL").orderBy("position").limit(cap).agg(F.max("position")).first()[0]
        judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("position") > F.lit(last)), "max_concepts").otherwise(F.col("reason")))
    return judged.withColumn("outcome", F.coalesce("reason", F.lit("approved"))).drop("reason")


def active(granted_at: Column, bound: Column, as_of: int) -> Column:
    """A control without a bound is active; one with a bound until it has elapsed."""
    return bound.isNull() | (as_of - granted_at < bound)


def controlled(concepts: DataFrame, controls: DataFrame, profile: str, as_of: int) -> DataFrame:
    """Concepts with whether a control allows them for a profile; without a control they are denied."""
    on = controls.where((F.col("profile_id") == profile) & active(F.col("granted_at"), F.col("bound_seconds"), as_of)).select(F.col("concept_id").alias("id"), "scope_id").distinct().withColumn("allowed", F.lit(True))
    return concepts.join(on, ["id", "scope_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def proposal_error(as_valid: str | None = None) -> Column:
    """The first thing wrong with a proposal, or null."""
    confidence = F.col("confidence")
    return (
        F.when(F.isnan(confidence), "confidence_nan").when((confidence < 0) | (confidence > 1), "confidence_range").when(F.col("scope_id") == "", "nil_scope")
        .when(F.trim("agent_id") == "", "empty_agent").when(F.col("ttl_seconds") == 0, "zero_ttl").when(F.trim("content") == "", "empty_content")
    )


def auto_promotes(confidence: float = 0.9, corroborations: int = 2, ceiling: str = "useful") -> Column:
    return (F.col("confidence") >= confidence) & (F.col("corroboration_count") >= corroborations) & (rank(F.col("sensitivity")) <= RANK[ceiling]) & (F.col("sensitivity") != "critical")


def review(as_of: int) -> Column:
    """What a review of a submitted proposal comes to."""
    terminal = F.col("status").isin("promoted", "rejected")
    expired = F.col("submitted_at") + F.col("ttl_seconds") <= as_of
    return F.when(terminal, "invalid_transition").when(expired, "rejected_expired").when(F.col("status") != "submitted", "invalid_transition").when(auto_promotes(), "auto_promoted").otherwise("needs_human_review")


def reachable(tuples: DataFrame, object_type: str, wanted: str, scratch: Scratch) -> DataFrame:
    """``(object_id, subject_id)``: who holds the wanted relation on objects of a type, through groups of groups.

    The frontier of a round is what the last one added, so each pair (object, group) is
    expanded once and cycles end by themselves.
    """
    first = tuples.where((F.col("object_type") == object_type) & F.col("relation").isin(covering(wanted)))
    held = first.select("object_id", F.col("subject_type").alias("type"), F.col("subject_id").alias("id"), F.col("subject_relation").alias("relation"))
    seen = scratch.keep(held.distinct(), "held")
    fresh = seen
    given = tuples.where("subject_id IS NOT NULL").select(F.col("object_type").alias("type"), F.col("object_id").alias("id"), F.col("relation").alias("has"), F.col("subject_type").alias("next_type"), F.col("subject_id").alias("next_id"), F.col("subject_relation").alias("next_relation"))
    implied = F.create_map(*[x for held_, gives in IMPLIES.items() for x in (F.lit(held_), F.array(*map(F.lit, gives)))])
    while True:
        step = fresh.where("relation IS NOT NULL").join(given, ["type", "id"]).where(F.array_contains(implied[F.col("has")], F.col("relation")))
        new = step.select("object_id", F.col("next_type").alias("type"), F.col("next_id").alias("id"), F.col("next_relation").alias("relation")).distinct()
        same = [seen[c].eqNullSafe(new[c]) for c in ("object_id", "type", "id", "relation")]
        fresh = scratch.keep(new.join(seen, same[0] & same[1] & same[2] & same[3], "left_anti"), "round")
        if fresh.isEmpty():
            break
        seen = scratch.keep(seen.union(fresh), "held")
    return seen.where("relation IS NULL AND type = 'user'").select("object_id", F.col("id").alias("subject_id")).distinct()


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What has to be granted and revoked to get from one set of rows to another."""
    return after.exceptAll(before).withColumn("operation", F.lit("grant")).union(before.exceptAll(after).withColumn("operation", F.lit("revoke")))


def last_change(deltas: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The change of each key that came last, and so counts."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return deltas.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def leaks(evidence: DataFrame) -> DataFrame:
    """``(scope_id, leaks)``: evidence in a scope whose content was first seen in another one."""
    home = evidence.groupBy("content_hash").agg(F.min_by("scope_id", F.struct("created_at", "evidence_id")).alias("home"))
    return evidence.join(home, "content_hash").where("scope_id <> home").groupBy("scope_id").agg(F.count("*").alias("leaks"))


def tenant_status(events: DataFrame) -> DataFrame:
    """``(tenant_id, status, first_suspended)`` after suspends and resumes in order of ``(moment, id)``.

    Suspending a suspended tenant and resuming an active one are refused and change nothing, so
    that the last event decides, whatever was refused before.
    """
    return events.groupBy("tenant_id").agg(
        F.when(F.max_by("kind", F.struct("moment", "id")) == "suspend", "suspended").otherwise("active").alias("status"),
        F.min(F.when(F.col("kind") == "suspend", F.col("moment"))).alias("first_suspended"),
    )
