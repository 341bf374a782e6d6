"""Ageing memory: retention scores, decay, policies, the state machine, sessions and working memory.

Objects are rows; everything that depends on the clock takes ``as_of`` in seconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.relational import count_where

DAY = 86_400

# Half-lives in days by class of sensitivity, and of not being used, by cultural context.
HALF_LIVES = {
    "default": {"critical": 36500.0, "important": 730.0, "useful": 30.0, "noise": 1.0, "non_use": 14.0},
    "high": {"critical": 36500.0, "important": 1095.0, "useful": 60.0, "noise": 3.0, "non_use": 21.0},
    "low": {"critical": 36500.0, "important": 547.5, "useful": 21.0, "noise": 0.5, "non_use": 10.0},
}
HIGH_CONTEXT = ["ja", "ko", "zh", "th", "vi", "id", "ms", "my", "km", "lo", "bo"]
LOW_CONTEXT = ["en", "de", "fr", "es", "it", "pt", "nl", "sv", "da", "no", "fi"]
WEIGHTS = {"pinning": 0.5, "retrieval": 0.15, "corroboration": 0.10, "contradiction": 0.05, "age": 0.10, "non_use": 0.10}
PINNED_FLOOR = 0.9
SESSION_MARKERS = ["/end", "/wrap", "session ended", "let's wrap up", "ttyl"]

# Which state may become which.
TRANSITIONS = {
    "reinforced": ["candidate", "archived"],
    "consolidated": ["reinforced"],
    "canonical": ["consolidated"],
    "superseded": ["canonical"],
    "archived": ["candidate", "reinforced", "consolidated", "canonical", "superseded"],
    "deleted": ["candidate", "reinforced", "consolidated", "canonical", "superseded", "archived"],
}


def decay(elapsed: Column, half_life: Column) -> Column:
    """Half of what was there after each half-life; 0 without one."""
    kept = F.pow(F.lit(2.0), -F.greatest(elapsed, F.lit(0)) / half_life)
    return F.when(half_life <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(kept, F.lit(0.0)), F.lit(1.0)))


def context_of(language: Column) -> Column:
    """The cultural context of a language tag, by its primary part."""
    primary = F.lower(F.substring_index(language, "-", 1))
    return F.when(primary.isin(HIGH_CONTEXT), "high").when(primary.isin(LOW_CONTEXT), "low").otherwise("default")


def half_life(sensitivity: Column, context: Column | str = "default") -> Column:
    """Seconds of half-life for a class of sensitivity, or for ``non_use``, in a context."""
    context = F.lit(context) if isinstance(context, str) else context
    out = F.lit(None).cast("double")
    for name, days in HALF_LIVES.items():
        for kind, d in days.items():
            out = F.when((context == name) & (sensitivity == kind), F.lit(d * DAY)).otherwise(out)
    return out


def contradicted(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.contradicted") == "true", F.lit(False))


def retention_score(as_of: int, context: Column | str = "default", weights: dict[str, float] | None = None) -> Column:
    """A memory object's retention score; a pin keeps it at the floor or above."""
    w = weights or WEIGHTS
    pinned = F.col("pin_count") > 0
    total = (
        w["pinning"] * F.when(pinned, 1.0).otherwise(0.0)
        + w["retrieval"] * F.least(F.col("retrieval_count") / 5.0, F.lit(1.0))
        + w["corroboration"] * F.least(F.col("corroboration_count") / 3.0, F.lit(1.0))
        + w["contradiction"] * F.when(contradicted(F.col("metadata")), 0.0).otherwise(1.0)
        + w["age"] * decay(F.lit(as_of) - F.col("created_at"), half_life(F.col("sensitivity"), context))
        + w["non_use"] * decay(F.lit(as_of) - F.col("last_accessed_at"), half_life(F.lit("non_use"), context))
    )
    kept = F.when(pinned, F.greatest(total, F.lit(PINNED_FLOOR))).otherwise(total)
    return F.least(F.greatest(kept, F.lit(0.0)), F.lit(1.0))


def decay_sweep(objects: DataFrame, as_of: int, threshold: float = 0.15, superseded_ttl: int = 90 * DAY) -> DataFrame:
    """Objects with their score and what becomes of their state: weak candidates and long superseded ones are archived, critical ones never."""
    scored = objects.withColumn("retention_score", retention_score(as_of))
    mortal = F.col("sensitivity") != "critical"
    weak = mortal & (F.col("state") == "candidate") & (F.col("retention_score") < threshold)
    stale = mortal & (F.col("state") == "superseded") & (as_of - F.col("last_accessed_at") >= superseded_ttl)
    return scored.withColumn("new_state", F.when(weak | stale, "archived").otherwise(F.col("state")))


def decay_report(swept: DataFrame) -> DataFrame:
    archived = F.col("new_state") == "archived"
    return swept.agg(
        F.count("*").alias("scored"),
        count_where("candidates_archived", archived & (F.col("state") == "candidate")),
        count_where("superseded_archived", archived & (F.col("state") == "superseded")),
    )


@dataclass(frozen=True)
class Policy:
    """A retention policy; times in seconds."""

    name: str = "global-default"
    candidate_threshold: float = 0.15
    superseded_after: int = 90 * DAY
    min_retention: int = 365 * DAY
    archived_max: int | None = None
    reinforce_after: int = 3
    consolidate_after: int = 2
    canonical_after: int | None = 7 * DAY
    legal_hold: bool = False
    hold_until: int | None = None
    keep_until: int | None = None
    gone_after: int | None = None
    resurrect: bool = True
    resurrect_after: int = 1
    archive_on: tuple[str, ...] = field(default=())
    delete_on: tuple[str, ...] = field(default=())
    preserve_on: tuple[str, ...] = field(default=())


GLOBAL = Policy()
BUSINESS = Policy("b2b-default", 0.10, 365 * DAY, 365 * 7 * DAY, 365 * 10 * DAY, 5, 3, None, archive_on=("project_closed",), preserve_on=("litigation_hold",))
CONSUMER = Policy("b2c-default", 0.20, 30 * DAY, 365 * DAY, 365 * 3 * DAY, 2, 2, DAY, archive_on=("account_closed",), delete_on=("user_requested_deletion",))


def policy_decision(policy: Policy, as_of: int, score: Column, events: Column | None = None) -> Column:
    """What a policy decides on an object: the first rule that applies. events: the active events of its scope."""
    events = F.array().cast("array<string>") if events is None else F.coalesce(events, F.array().cast("array<string>"))
    on = lambda names: F.arrays_overlap(events, F.array(*map(F.lit, names))) if names else F.lit(False)
    state, age = F.col("state"), as_of - F.col("created_at")
    held = F.lit(policy.legal_hold and (policy.hold_until is None or as_of < policy.hold_until))
    explicit = F.lit(policy.keep_until is not None and as_of < policy.keep_until)
    young = explicit | (age < policy.min_retention)
    rules = [
        (held | on(policy.preserve_on), "keep"),
        (F.lit(policy.gone_after is not None and as_of >= policy.gone_after), "delete"),
        (on(policy.delete_on), "delete"),
        (on(policy.archive_on) & ~explicit, "archive"),
        ((state == "archived") & F.lit(policy.resurrect) & (F.col("retrieval_count") >= policy.resurrect_after), "resurrect"),
        ((state == "candidate") & (F.col("retrieval_count") >= policy.reinforce_after) & (score >= 0.4), "promote_to_reinforced"),
        ((state == "reinforced") & (F.col("corroboration_count") >= policy.consolidate_after), "promote_to_consolidated"),
    ]
    if policy.canonical_after is not None:
        rules.append(((state == "consolidated") & (as_of >= F.coalesce("consolidated_at", "created_at") + policy.canonical_after), "promote_to_canonical"))
    rules += [
        (state.isin("candidate", "superseded") & young, "keep"),
        ((state == "candidate") & (score < policy.candidate_threshold), "archive"),
        ((state == "superseded") & (as_of >= F.col("last_accessed_at") + policy.superseded_after), "archive"),
    ]
    if policy.archived_max is not None:
        rules.append(((state == "archived") & (age >= policy.archived_max), "delete"))
    out = F.lit("keep")
    for condition, decision in reversed(rules):
        out = F.when(condition, decision).otherwise(out)
    return out


def legal(state: Column, to: Column) -> Column:
    """Whether the state machine has this transition."""
    out = F.lit(False)
    for target, sources in TRANSITIONS.items():
        out = F.when(to == target, state.isin(sources)).otherwise(out)
    return out


def apply_decision(state: Column, decision: Column) -> Column:
    """The state after a decision; one that the state machine doesn't allow changes nothing."""
    targets = {"archive": "archived", "delete": "deleted", "resurrect": "reinforced", "promote_to_reinforced": "reinforced", "promote_to_consolidated": "consolidated", "promote_to_canonical": "canonical"}
    to = state
    for name, target in targets.items():
        to = F.when(decision == name, target).otherwise(to)
    return F.when((to != state) & legal(state, to), to).otherwise(state)


def resolve_policy(objects: DataFrame, by_scope: DataFrame, by_tenant: DataFrame, default: str) -> DataFrame:
    """The policy's name of each object: its scope's, else its tenant's, else the default."""
    return (
        objects.join(by_scope.select("scope_id", F.col("policy").alias("_s")), "scope_id", "left")
        .join(by_tenant.select("tenant_id", F.col("policy").alias("_t")), "tenant_id", "left")
        .withColumn("policy", F.coalesce("_s", "_t", F.lit(default)))
        .drop("_s", "_t")
    )


def purge(objects: DataFrame, as_of: int, ttl: int = 365 * DAY, pinned_too: bool = False) -> DataFrame:
    """Archived objects with what a purge does with them: purged, skipped_pinned or skipped_within_ttl."""
    pinned = (F.col("pin_count") > 0) & (not pinned_too)
    return objects.where("state = 'archived'").withColumn("outcome", F.when(pinned, "skipped_pinned").when(as_of - F.col("last_accessed_at") < ttl, "skipped_within_ttl").otherwise("purged"))


def sessions(observations: DataFrame, gap: int = 1800, markers: list[str] | None = None) -> DataFrame:
    """Observations with the number of their session in their scope, and why the session before ended.

    A session ends after an explicit marker, or after a pause of ``gap`` or more; the marker
    names the reason where both hold. Scopes are apart from each other, as they are partitions.
    """
    markers = SESSION_MARKERS if markers is None else markers
    order = Window.partitionBy("scope_id").orderBy("occurred_at", "id")
    before = F.lag("body").over(order)
    marked = F.coalesce(F.lower(before).rlike("|".join("\\Q" + m + "\\E" for m in markers)), F.lit(False)) if markers else F.lit(False)
    paused = F.col("occurred_at") - F.lag("occurred_at").over(order) >= gap
    why = F.when(marked, "explicit_action").when(paused, "time_gap")
    flagged = observations.withColumn("closed_by", why)
    return flagged.withColumn("session", F.sum(F.col("closed_by").isNotNull().cast("bigint")).over(order))


def session_table(marked: DataFrame) -> DataFrame:
    """A row for each session: bounds, members, why it ended (the last of a scope: time_gap)."""
    rows = marked.groupBy("scope_id", "session").agg(
        F.min("occurred_at").alias("started_at"),
        F.max("occurred_at").alias("ended_at"),
        F.count("*").alias("members"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "id", "body"))), lambda o: o["body"]), " / ").alias("summary"),
        F.max(F.when(F.col("closed_by").isNotNull(), F.col("closed_by"))).alias("opened_after"),
    )
    nxt = F.lead("opened_after").over(Window.partitionBy("scope_id").orderBy("session"))
    return rows.withColumn("boundary", F.coalesce(nxt, F.lit("time_gap"))).drop("opened_after")


def retention_precision(objects: DataFrame) -> DataFrame:
    """Of the objects that were kept, the share that was ever retrieved."""
    kept = ~F.col("state").isin("archived", "deleted")
    counts = objects.agg(count_where("retained", kept), count_where("retrieved", kept & (F.col("retrieval_count") > 0)))
    return counts.withColumn("precision", F.when(F.col("retained") == 0, 0.0).otherwise(F.col("retrieved") / F.col("retained")))


def corroborate(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Objects with the number of distinct sources that bear them out."""
    found = sources.groupBy("id").agg(F.countDistinct("source").alias("distinct_sources"), F.max("moment").alias("last_source_at"))
    return objects.join(found, "id", "left").fillna({"distinct_sources": 0})


def surface(text: Column) -> Column:
    """The form in which texts are compared: one space between words, ASCII letters in lower case."""
    return F.translate(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def current(objects: DataFrame, kind: str) -> DataFrame:
    """Objects of a kind that are neither completed nor superseded."""
    return objects.where((F.col("kind") == kind) & F.col("completed_at").isNull() & F.col("superseded_by").isNull())
