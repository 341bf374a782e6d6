"""Checks of what an engine did, and decisions by fixed rules: retrieval, forgetting, regressions, refined entities, prompts, roles, promotion, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import text as tx
from cairn.operators.relational import latest

# ---- verification


def verify_retrieval(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """``(turn_id, assertion, passed)``: three for each turn, two for noise.

    turns: (turn_id, importance, expected_id), with importance 0 for noise. hits: (turn_id, evidence_id,
    score). A turn that isn't noise has hits; the expected evidence is among them; no score is
    zero or less. Hits are counted before they are shuffled.
    """
    wanted = turns.select("turn_id", "importance", "expected_id")
    seen = hits.join(wanted, "turn_id").groupBy("turn_id").agg(F.count("*").alias("n"), F.bool_or(F.col("evidence_id") == F.col("expected_id")).alias("found"), F.bool_and(F.coalesce(F.col("score") > 0, F.lit(False))).alias("positive"))
    judged = wanted.join(seen, "turn_id", "left")
    says = lambda name, passed: F.struct(F.lit(name).alias("assertion"), F.coalesce(passed, F.lit(False)).alias("passed"))
    always = F.array(says("retrieval_expected_id_found", F.col("found")), says("retrieval_scores_positive", F.coalesce("positive", F.lit(True))))
    each = F.when(F.col("importance") > 0, F.concat(F.array(says("retrieval_nonempty", F.coalesce("n", F.lit(0)) > 0)), always)).otherwise(always)
    return judged.select("turn_id", F.explode(each).alias("a")).select("turn_id", "a.*")


def verify_forget(scopes: DataFrame, bodies: DataFrame, hits: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``(scope_id, assertion, passed)``: nothing can be read of a scope, nothing is found in it, and its tombstone is there. The last three: (scope_id) of what is left, of what a search finds, of what was recorded."""
    has = lambda frame, name: frame.groupBy("scope_id").agg(F.lit(True).alias(name))
    seen = scopes.select("scope_id").distinct().join(has(bodies, "body"), "scope_id", "left").join(has(hits, "hit"), "scope_id", "left").join(has(tombstones, "told"), "scope_id", "left")
    says = lambda name, passed: F.struct(F.lit(name).alias("assertion"), passed.alias("passed"))
    each = F.array(says("forget_body_unreadable", F.col("body").isNull()), says("forget_fts_empty", F.col("hit").isNull()), says("forget_tombstone_recorded", F.col("told").isNotNull()))
    return seen.select("scope_id", F.explode(each).alias("a")).select("scope_id", "a.*")


def regressions(measured: DataFrame, baselines: DataFrame, tolerance: float) -> DataFrame:
    """``(metric, value, baseline, regressed)``: worse than its baseline by more than a share, in the metric's own direction; a metric without a baseline hasn't regressed.

    measured: (metric, value); baselines: (metric, baseline, direction), ``lower_is_better`` or ``higher_is_better``.
    """
    worse = F.when(F.col("direction") == "lower_is_better", F.col("value") > F.col("baseline") * (1 + tolerance)).when(F.col("direction") == "higher_is_better", F.col("value") < F.col("baseline") * (1 - tolerance))
    return measured.join(baselines, "metric", "left").select("metric", "value", "baseline", F.coalesce(worse, F.lit(False)).alias("regressed"))


# ---- entities that have no type yet

# What stands beside a person, an organisation or an amount.
PERSON_BEFORE = ["Mr.", "Ms.", "Mrs.", "Dr.", "Prof.", "Sir", "Madam"]
PERSON_AFTER = ["様", "氏", "君", "さん", "씨"]
ORGANISATION_AFTER = ["Inc.", "Ltd.", "Corp.", "Corporation", "LLC", "GmbH", "株式会社", "有限公司", "주식회사"]
ORGANISATION_BEFORE = ["株式会社", "有限公司", "주식회사", "有限会社"]
MONEY_BEFORE = ["$", "€", "¥", "£", "₹", "₩", "₫", "฿", "₪"]


def refined(text: Column, start: Column, entity: Column, window: int = 50) -> Column:
    """``(kind, confidence)`` that the ``window`` characters on both sides of an entity speak for; the first rule that fits. start: in characters, from 0."""
    before = F.rtrim(text.substr(F.greatest(start - window + 1, F.lit(1)), F.least(start, F.lit(window))))
    after = F.ltrim(text.substr(start + F.length(entity) + 1, F.lit(window)))
    ends = lambda words: before.rlike(f"(?:{tx.any_of(words)})$")
    begins = lambda words: after.rlike(f"^(?:{tx.any_of(words)})")
    dated = entity.rlike("^[0-9/-]*-[0-9/-]*$") & (F.length(F.regexp_replace(entity, "[^0-9]", "")) >= 4)
    says = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    return (
        F.when(ends(PERSON_BEFORE), says("person", 0.85)).when(begins(PERSON_AFTER), says("person", 0.8)).when(begins(ORGANISATION_AFTER), says("organization", 0.85))
        .when(ends(ORGANISATION_BEFORE), says("organization", 0.85)).when(ends(MONEY_BEFORE), says("currency", 0.9)).when(dated, says("date", 0.75)).otherwise(says("unknown", 0.0))
    )


def apply_refinement(current: Column, kind: Column, confidence: Column, least: float = 0.7) -> Column:
    """The refined type where it is sure enough, else the one that was there."""
    return F.when(confidence >= least, kind).otherwise(current)


# ---- prompts

# How a prompt is put together.
PROMPT_INPUTS, PROMPT_END = "--- {} synthesis inputs ---", "--- end inputs ---"
PROMPT_ASKS = "Produce the {} synthesis output following the grammar constraints. Output only the JSON object, no preamble or explanation."


def prompts(inputs: DataFrame, systems: dict[str, str], most: int, width: int) -> DataFrame:
    """``(scope_id, tier, prompt, inputs)`` for each scope and tier: the tier's own words, then at most ``most`` previews of ``width`` characters in order, numbered from 0.

    inputs: (scope_id, tier, at, id, body). Spark limits a scope's inputs before they are shuffled.
    """
    order = Window.partitionBy("scope_id", "tier").orderBy("at", "id")
    first = inputs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("scope_id", "tier", "_n", F.substring(F.coalesce("body", F.lit("")), 1, width).alias("preview"))
    rows = first.groupBy("scope_id", "tier").agg(F.array_sort(F.collect_list(F.struct("_n", "preview"))).alias("p"))
    lines = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), (x["_n"] - 1).cast("string"), F.lit("] "), x["preview"], F.lit("\n"))), "")
    system = F.create_map(*[x for k, w in systems.items() for x in (F.lit(k), F.lit(w))])[F.col("tier")]
    said = lambda form: F.concat(*[p for k, part in enumerate(form.split("{}")) for p in (([F.col("tier")] if k else []) + [F.lit(part)])])
    prompt = F.concat(F.coalesce(system, F.lit("")), F.lit("\n\n"), said(PROMPT_INPUTS), F.lit("\n"), lines, F.lit(f"\n{PROMPT_END}\n"), said(PROMPT_ASKS))
    return rows.select("scope_id", "tier", prompt.alias("prompt"), F.size("p").alias("inputs"))


# ---- roles, promotion, routing

# The form of a group's name that gives its members a role.
ROLE_FORM = r"^([^:]*):([^:]*):([^:]*):([^:]*)$"
UUID_FORM = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def group_role(name: Column, namespace: str, object_type: str, roles: list[str]) -> Column:
    """``(tenant_id, role)`` of a name ``namespace:object:uuid:role``; null if it is another name."""
    part = lambda k: F.regexp_extract(name, ROLE_FORM, k)
    ok = name.rlike(ROLE_FORM) & (part(1) == namespace) & (part(2) == object_type) & part(3).rlike(UUID_FORM) & part(4).isin(roles)
    return F.when(ok, F.struct(part(3).alias("tenant_id"), part(4).alias("role")))


def promotion(observations: DataFrame, batch: list[str], floor: int, corroborated: int, noise: float) -> DataFrame:
    """Adds ``reason``: why an observation isn't promoted, or ``promoted``; the first rule that fails.

    observations: with importance (0 is noise) and corroboration_count. Noise is the share of a batch's
    observations of importance 0; shares are counted before anything is shuffled.
    """
    shares = observations.groupBy(*batch).agg(F.avg(F.when(F.col("importance") == 0, 1.0).otherwise(0.0)).alias("_noise"))
    reason = F.when(F.col("importance") < floor, "below_importance_floor").when(F.col("corroboration_count") < corroborated, "insufficient_corroboration").when(F.col("_noise") > noise, "batch_too_noisy").otherwise("promoted")
    return observations.join(shares, batch).withColumn("reason", reason).drop("_noise")


def route_communities(summaries: DataFrame, visible: DataFrame, words: list[str], limit: int) -> DataFrame:
    """``(id, score)`` of the best summaries for a query's words, among those whose scopes may all be seen.

    summaries: (id, summary, concepts array, scopes array); visible: (scope_id). A word counts 2 for each
    concept that holds it and 1 for the summary. A summary without scopes is never seen; nor is
    anything for a query without words.
    """
    own = [w for w in dict.fromkeys(words) if w]
    if not own:
        return summaries.select("id", F.lit(0).alias("score")).where("false")
    hidden = summaries.select("id", F.explode("scopes").alias("scope_id")).join(visible.select("scope_id").distinct(), "scope_id", "left_anti").select("id").distinct()
    shown = summaries.where(F.size("scopes") > 0).join(hidden, "id", "left_anti")
    worth = lambda w: 2 * F.size(F.filter("concepts", lambda c: F.lower(c).contains(w))) + F.lower("summary").contains(w).cast("int")
    score = reduce(lambda a, b: a + b, map(worth, own))
    return shown.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


# ---- writes that may come again


def upsert_blobs(held: DataFrame, new: DataFrame) -> DataFrame:
    """``(scope_id, kind, blob)`` after saving: a new blob takes the place of the one with its key; of new ones with one key the last (``at``) counts."""
    both = held.select("scope_id", "kind", F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("turn"), "blob").unionByName(new.select("scope_id", "kind", F.col("at").cast("bigint").alias("at"), F.lit(1).alias("turn"), "blob"))
    return latest(both, ["scope_id", "kind"], ["turn", "at", "blob"]).select("scope_id", "kind", "blob")


def append_once(held: DataFrame, new: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """``held`` with the rows of ``new`` whose id it doesn't have; of new rows with one id the first in order is taken, the others are let go."""
    from cairn.operators.relational import earliest

    fresh = earliest(new, [id_], order).join(held.select(id_), id_, "left_anti")
    return held.unionByName(fresh.select(*held.columns))
