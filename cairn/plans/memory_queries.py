"""Queries over memory objects, policies and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import memory as mem
from cairn.operators.relational import count_where, earliest, latest, top_per, where_equal, without
from cairn.registry import AS_OF, query

HALF = "CASE sensitivity WHEN 'critical' THEN 36500.0 WHEN 'important' THEN 730.0 WHEN 'useful' THEN 30.0 ELSE 1.0 END"


def _score(half: str = HALF, idle: str = "14.0") -> str:
    total = (f"0.5 * CASE WHEN pin_count > 0 THEN 1 ELSE 0 END + 0.15 * least(retrieval_count / 5.0, 1.0) + 0.10 * least(corroboration_count / 3.0, 1.0) + 0.05 * CASE WHEN metadata LIKE '%\"contradicted\": true%' THEN 0 ELSE 1 END"
             f" + 0.10 * pow(2.0, -(1706745600 - created_at) / ({half} * 86400.0)) + 0.10 * pow(2.0, -(1706745600 - last_accessed_at) / ({idle} * 86400.0))")
    return f"CASE WHEN pin_count > 0 THEN greatest({total}, 0.9) ELSE {total} END"


SCORE = _score()
SCORED = f"(SELECT *, {SCORE} AS score FROM memory)"

query("fn.retention_score", f"SELECT id, round({SCORE}, 6) AS score FROM memory")(lambda v: v.memory.select("id", F.round(mem.retention_score(AS_OF), 6).alias("score")))
_CONTEXT = "CASE WHEN split_part(language_tag, '-', 1) IN ('ja', 'th') THEN 'high' WHEN split_part(language_tag, '-', 1) = 'en' THEN 'low' ELSE 'default' END"
_BY_CONTEXT = f"CASE sensitivity WHEN 'critical' THEN 36500.0 WHEN 'important' THEN CASE {_CONTEXT} WHEN 'high' THEN 1095.0 WHEN 'low' THEN 547.5 ELSE 730.0 END WHEN 'useful' THEN CASE {_CONTEXT} WHEN 'high' THEN 60.0 WHEN 'low' THEN 21.0 ELSE 30.0 END ELSE CASE {_CONTEXT} WHEN 'high' THEN 3.0 WHEN 'low' THEN 0.5 ELSE 1.0 END END"
_IDLE = f"CASE {_CONTEXT} WHEN 'high' THEN 21.0 WHEN 'low' THEN 10.0 ELSE 14.0 END"
query("fn.retention_profile", f"SELECT id, round({_score(_BY_CONTEXT, _IDLE)}, 6) AS score FROM memory")(
    lambda v: v.memory.select("id", F.round(mem.retention_score(AS_OF, mem.context_of(F.col("language_tag"))), 6).alias("score")))
query("fn.decay_profile_lang", f"SELECT DISTINCT language_tag, {_CONTEXT} AS context FROM memory")(lambda v: v.memory.select("language_tag", mem.context_of(F.col("language_tag")).alias("context")).distinct())
query("fn.half_life", f"SELECT DISTINCT sensitivity, {HALF} * 86400.0 AS seconds FROM memory")(lambda v: v.memory.select("sensitivity", mem.half_life(F.col("sensitivity")).alias("seconds")).distinct())
query("fn.exp_decay", "SELECT id, round(exp(-(1706745600 - created_at) * ln(2) / 604800.0), 6) AS kept FROM memory")(
    lambda v: v.memory.select("id", F.round(mem.decay(AS_OF - F.col("created_at"), F.lit(7.0 * 86400)), 6).alias("kept")))
query("lc.decay_sweep", f"SELECT id, state, CASE WHEN sensitivity <> 'critical' AND ((state = 'candidate' AND score < 0.15) OR (state = 'superseded' AND 1706745600 - last_accessed_at >= 864000)) THEN 'archived' ELSE state END AS new_state FROM {SCORED}")(
    lambda v: mem.decay_sweep(v.memory, AS_OF, superseded_ttl=10 * mem.DAY).select("id", "state", "new_state"))
query("agg.decay_report", f"SELECT count(*) AS scored, count(*) FILTER (WHERE sensitivity <> 'critical' AND state = 'candidate' AND score < 0.4) AS candidates_archived, count(*) FILTER (WHERE sensitivity <> 'critical' AND state = 'superseded' AND 1706745600 - last_accessed_at >= 259200) AS superseded_archived FROM {SCORED}")(
    lambda v: mem.decay_report(mem.decay_sweep(v.memory, AS_OF, 0.4, 3 * mem.DAY)))

_DECISION = f"""CASE WHEN state = 'archived' AND retrieval_count >= 1 THEN 'resurrect' WHEN state = 'candidate' AND retrieval_count >= 3 AND score >= 0.4 THEN 'promote_to_reinforced'
    WHEN state = 'reinforced' AND corroboration_count >= 2 THEN 'promote_to_consolidated' WHEN state = 'consolidated' AND 1706745600 >= coalesce(consolidated_at, created_at) + 604800 THEN 'promote_to_canonical'
    WHEN state IN ('candidate', 'superseded') AND 1706745600 - created_at < 31536000 THEN 'keep' WHEN state = 'candidate' AND score < 0.15 THEN 'archive' WHEN state = 'superseded' AND 1706745600 >= last_accessed_at + 7776000 THEN 'archive' ELSE 'keep' END"""
_EVENTS = "CASE CAST(scope_id AS BIGINT) % 5 WHEN 1 THEN 'account_closed' WHEN 2 THEN 'user_requested_deletion' ELSE 'none' END"
_CONSUMER = f"""CASE WHEN {_EVENTS} = 'user_requested_deletion' THEN 'delete' WHEN {_EVENTS} = 'account_closed' THEN 'archive' WHEN state = 'archived' AND retrieval_count >= 1 THEN 'resurrect' WHEN state = 'candidate' AND retrieval_count >= 2 AND score >= 0.4 THEN 'promote_to_reinforced'
    WHEN state = 'reinforced' AND corroboration_count >= 2 THEN 'promote_to_consolidated' WHEN state = 'consolidated' AND 1706745600 >= coalesce(consolidated_at, created_at) + 86400 THEN 'promote_to_canonical' ELSE 'keep' END"""


def _consumer(v):
    number = F.col("scope_id").cast("bigint") % 5
    events = F.when(number == 1, F.array(F.lit("account_closed"))).when(number == 2, F.array(F.lit("user_requested_deletion")))
    return v.memory.withColumn("decision", mem.policy_decision(mem.CONSUMER, AS_OF, mem.retention_score(AS_OF), events))


query("lc.policy_evaluate", f"SELECT id, {_CONSUMER} AS decision FROM {SCORED}")(lambda v: _consumer(v).select("id", "decision"))
query("agg.policy_sweep_report", f"SELECT {_DECISION} AS decision, count(*) AS n FROM {SCORED} GROUP BY 1")(
    lambda v: v.memory.select(mem.policy_decision(mem.GLOBAL, AS_OF, mem.retention_score(AS_OF)).alias("decision")).groupBy("decision").agg(F.count("*").alias("n")))
query("lc.policy_sweep", f"""SELECT id, state, CASE WHEN d = 'delete' AND state <> 'deleted' THEN 'deleted' WHEN d = 'archive' AND state NOT IN ('archived', 'deleted') THEN 'archived' WHEN d = 'resurrect' THEN 'reinforced' WHEN d = 'promote_to_reinforced' THEN 'reinforced'
    WHEN d = 'promote_to_consolidated' THEN 'consolidated' WHEN d = 'promote_to_canonical' THEN 'canonical' ELSE state END AS new_state FROM (SELECT *, {_CONSUMER} AS d FROM {SCORED})""")(
    lambda v: _consumer(v).select("id", "state", mem.apply_decision(F.col("state"), F.col("decision")).alias("new_state")))
query("lc.policy_resolve", "SELECT id, CASE WHEN CAST(scope_id AS BIGINT) % 4 = 0 THEN 'scope-policy' WHEN CAST(scope_id AS BIGINT) % 3 = 1 THEN 'tenant-policy' ELSE 'global-default' END AS policy FROM memory")(
    lambda v: mem.resolve_policy(v.memory.withColumn("tenant_id", F.col("scope_id").cast("bigint") % 3), v.memory.where("scope_id % 4 = 0").select("scope_id", F.lit("scope-policy").alias("policy")).distinct(),
                                 v.memory.where("scope_id % 3 = 1").select((F.col("scope_id").cast("bigint") % 3).alias("tenant_id"), F.lit("tenant-policy").alias("policy")).distinct(), "global-default").select("id", "policy"))
query("lc.transitions", """SELECT a.state AS from_state, b.state AS to_state, CASE b.state WHEN 'reinforced' THEN a.state IN ('candidate', 'archived') WHEN 'consolidated' THEN a.state = 'reinforced' WHEN 'canonical' THEN a.state = 'consolidated' WHEN 'superseded' THEN a.state = 'canonical'
    WHEN 'archived' THEN a.state IN ('candidate', 'reinforced', 'consolidated', 'canonical', 'superseded') WHEN 'deleted' THEN a.state <> 'deleted' ELSE false END AS legal FROM (SELECT DISTINCT state FROM memory) a, (SELECT DISTINCT state FROM memory) b""")(
    lambda v: v.memory.select(F.col("state").alias("from_state")).distinct().withColumn("to_state", F.explode(F.array(*map(F.lit, ["candidate", *mem.TRANSITIONS])))).join(v.memory.select(F.col("state").alias("to_state")).distinct(), "to_state", "left_semi").select("from_state", "to_state", mem.legal(F.col("from_state"), F.col("to_state")).alias("legal")))
query("lc.purge", "SELECT id, CASE WHEN pin_count > 0 THEN 'skipped_pinned' WHEN 1706745600 - last_accessed_at < 432000 THEN 'skipped_within_ttl' ELSE 'purged' END AS outcome FROM memory WHERE state = 'archived'")(
    lambda v: mem.purge(v.memory, AS_OF, 5 * mem.DAY).select("id", "outcome"))
query("agg.purge_report", "SELECT count(*) AS examined, count(*) FILTER (WHERE pin_count > 0) AS skipped_pinned, count(*) FILTER (WHERE pin_count = 0 AND 1706745600 - last_accessed_at < 432000) AS skipped_within_ttl, count(*) FILTER (WHERE pin_count = 0 AND 1706745600 - last_accessed_at >= 432000) AS purged FROM memory WHERE state = 'archived'")(
    lambda v: mem.purge(v.memory, AS_OF, 5 * mem.DAY).agg(F.count("*").alias("examined"), *[count_where(o, F.col("outcome") == o) for o in ("skipped_pinned", "skipped_within_ttl", "purged")]))
query("lc.episodic_retrieval", "SELECT id, CASE WHEN state = 'candidate' THEN 'reinforced' ELSE state END AS state, round(least(0.3 + 0.1 * retrieval_count, 1.0), 6) AS score FROM memory")(
    lambda v: v.memory.select("id", F.when(F.col("state") == "candidate", "reinforced").otherwise(F.col("state")).alias("state"), F.round(F.least(0.3 + 0.1 * F.col("retrieval_count"), F.lit(1.0)), 6).alias("score")))
query("flt.memory_filter", "SELECT id FROM memory WHERE state IN ('candidate', 'canonical') AND scope_id = '7' AND observation_type = 'view'")(
    lambda v: where_equal(v.memory, scope_id="7", observation_type="view").where(F.col("state").isin("candidate", "canonical")).select("id"))
query("agg.retention_precision", "SELECT count(*) AS retained, count(*) FILTER (WHERE retrieval_count > 0) AS retrieved, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE retrieval_count > 0) / count(*) END AS precision FROM memory WHERE state NOT IN ('archived', 'deleted')")(
    lambda v: mem.retention_precision(v.memory))
query("agg.quality_report", "SELECT count(*) AS objects, count(*) FILTER (WHERE metadata LIKE '%: true%') AS contradicted, count(*) FILTER (WHERE state = 'archived') AS archived FROM memory")(
    lambda v: v.memory.agg(F.count("*").alias("objects"), count_where("contradicted", mem.contradicted(F.col("metadata"))), count_where("archived", F.col("state") == "archived")))
query("agg.decay_tuning_merge", "SELECT observation_type, CAST(sum(retrieval_count) AS BIGINT) AS retrieved, CAST(sum(pin_count) AS BIGINT) AS pinned FROM memory GROUP BY 1")(
    lambda v: v.memory.groupBy("observation_type").agg(F.sum("retrieval_count").alias("retrieved"), F.sum("pin_count").alias("pinned")))
query("nest.corroborate", "SELECT m.id, count(DISTINCT s.source) AS distinct_sources FROM memory m LEFT JOIN memory_sources s ON s.id = m.id GROUP BY m.id")(lambda v: mem.corroborate(v.memory, v.memory_sources).select("id", "distinct_sources"))
query("nest.metadata_flag", "SELECT id, metadata LIKE '%\"contradicted\": true%' AS contradicted FROM memory")(lambda v: v.memory.select("id", mem.contradicted(F.col("metadata")).alias("contradicted")))
query("nest.position_hint", "SELECT id, CAST(json_extract_string(metadata, '$.position.x') AS DOUBLE) AS x, CAST(json_extract_string(metadata, '$.position.y') AS DOUBLE) AS y FROM memory WHERE json_extract_string(metadata, '$.position.x') IS NOT NULL")(
    lambda v: v.memory.select("id", *[F.get_json_object("metadata", f"$.position.{a}").cast("double").alias(a) for a in "xy"]).where("x IS NOT NULL"))
query("win.capped_objects", f"SELECT id FROM {SCORED} ORDER BY round(score, 9) DESC, id LIMIT 256")(lambda v: v.memory.withColumn("s", F.round(mem.retention_score(AS_OF), 9)).orderBy(F.desc("s"), "id").limit(256).select("id"))

# ---- sessions

_FLAGS = """(SELECT *, CASE WHEN regexp_matches(lower(lag(body) OVER w), '/end|/wrap|session ended|let''s wrap up|ttyl') THEN 'explicit_action' WHEN occurred_at - lag(occurred_at) OVER w >= 1800 THEN 'time_gap' END AS closed_by FROM {0} WINDOW w AS (PARTITION BY scope_id ORDER BY occurred_at, id))"""
_SESSIONS = "(SELECT *, CAST(count(closed_by) OVER (PARTITION BY scope_id ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM " + _FLAGS + ")"
query("win.sessions", f"SELECT id, scope_id, session, closed_by FROM {_SESSIONS.format('observations')}")(lambda v: mem.sessions(v.observations).select("id", "scope_id", "session", "closed_by"))
_TABLE = f"(SELECT scope_id, session, min(occurred_at) AS started_at, max(occurred_at) AS ended_at, count(*) AS members, string_agg(body, ' / ' ORDER BY occurred_at, id) AS summary, max(closed_by) AS opened FROM {_SESSIONS.format('observations')} GROUP BY 1, 2)"
query("win.session_close", f"SELECT scope_id, session, started_at, ended_at, members, coalesce(lead(opened) OVER (PARTITION BY scope_id ORDER BY session), 'time_gap') AS boundary FROM {_TABLE}")(
    lambda v: mem.session_table(mem.sessions(v.observations)).select("scope_id", "session", "started_at", "ended_at", "members", "boundary"))
query("win.session_summary", f"SELECT scope_id, session, summary FROM {_TABLE} WHERE members >= 2")(lambda v: mem.session_table(mem.sessions(v.observations)).where("members >= 2").select("scope_id", "session", "summary"))
query("win.session_ingest", f"SELECT scope_id, count(*) AS episodes, CAST(sum(members) AS BIGINT) AS observations FROM (SELECT scope_id, session, count(*) AS members FROM {_SESSIONS.format('clicks')} GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY scope_id")(
    lambda v: mem.session_table(mem.sessions(v.clicks)).where("members >= 2").groupBy("scope_id").agg(F.count("*").alias("episodes"), F.sum("members").alias("observations")))
query("sec.episodes_by_scope", f"SELECT session, started_at, members FROM {_TABLE} WHERE scope_id = '3' AND members >= 2")(
    lambda v: mem.session_table(mem.sessions(v.observations.where("scope_id = '3'"))).where("members >= 2").select("session", "started_at", "members"))
query("sec.episode_forget", f"SELECT scope_id, session FROM {_TABLE} WHERE NOT (scope_id = '3' AND session = 0)")(
    lambda v: mem.session_table(mem.sessions(v.observations)).where("NOT (scope_id = '3' AND session = 0)").select("scope_id", "session"))
query("win.working_evict", "SELECT scope_id, arg_min(id, (retrieval_count, created_at, id)) AS evicted FROM memory GROUP BY scope_id HAVING count(*) > 3")(
    lambda v: v.memory.groupBy("scope_id").agg(F.min_by("id", F.struct("retrieval_count", "created_at", "id")).alias("evicted"), F.count("*").alias("n")).where("n > 3").drop("n"))
query("sec.working_context", "SELECT id FROM memory WHERE last_accessed_at + 86400 > 1706745600 - 172800")(lambda v: v.memory.where(F.col("last_accessed_at") + 86400 > AS_OF - 172800).select("id"))
query("sec.working_evict_expired", "SELECT count(*) FILTER (WHERE last_accessed_at + 86400 <= 1706745600 - 172800) AS expired FROM memory")(lambda v: v.memory.agg(count_where("expired", F.col("last_accessed_at") + 86400 <= AS_OF - 172800)))

# ---- channel, domain and tenant memory

_SURFACE = "translate(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
query("txt.surface_norm", f"SELECT id, {_SURFACE} AS surface FROM tasks")(lambda v: v.tasks.select("id", mem.surface(F.col("text")).alias("surface")))
for _op, _keys in (("txt.decision_dedup", ["scope_id", "surface"]), ("txt.task_dedup", ["scope_id", "surface", "assignee"]), ("txt.question_dedup", ["surface"])):
    query(_op, f"SELECT {', '.join(_keys)}, min(id) AS id FROM (SELECT *, {_SURFACE} AS surface FROM tasks) GROUP BY {', '.join(_keys)}")(
        lambda v, keys=_keys: earliest(v.tasks.withColumn("surface", mem.surface(F.col("text"))).select(*keys, "id"), keys, ["id"]))
query("agg.channel_decay", "SELECT count(*) FILTER (WHERE completed_at IS NOT NULL AND 1706745600 - completed_at >= 2592000) AS archived, count(*) FILTER (WHERE completed_at IS NULL) AS active FROM tasks")(
    lambda v: v.tasks.agg(count_where("archived", AS_OF - F.col("completed_at") >= 30 * mem.DAY), count_where("active", F.col("completed_at").isNull())))
query("agg.domain_decay", "SELECT scope_id, count(*) FILTER (WHERE completed_at IS NOT NULL AND 1706745600 - completed_at >= 1209600) AS archived FROM tasks GROUP BY scope_id")(
    lambda v: v.tasks.groupBy("scope_id").agg(count_where("archived", AS_OF - F.col("completed_at") >= 14 * mem.DAY)))
for _op, _what in (("sec.active_tasks", "task"), ("sec.open_questions", "question"), ("sec.active_workstreams", "workstream"), ("sec.open_dependencies", "dependency"), ("sec.open_risks", "risk"), ("sec.active_procedures", "procedure"), ("sec.active_policies", "policy"), ("sec.active_taxonomy", "taxonomy"), ("sec.active_facts", "fact")):
    query(_op, f"SELECT id, scope_id FROM tasks WHERE kind = '{_what}' AND completed_at IS NULL AND superseded_by IS NULL")(lambda v, what=_what: mem.current(v.tasks, what).select("id", "scope_id"))
query("sec.complete_task", "SELECT scope_id, min(completed_at) AS completed_at FROM tasks WHERE completed_at IS NOT NULL GROUP BY scope_id")(lambda v: v.tasks.where("completed_at IS NOT NULL").groupBy("scope_id").agg(F.min("completed_at").alias("completed_at")))
query("sec.resolve_question", "SELECT id, min(completed_at) AS resolved_at FROM tasks WHERE completed_at IS NOT NULL GROUP BY id")(lambda v: v.tasks.where("completed_at IS NOT NULL").groupBy("id").agg(F.min("completed_at").alias("resolved_at")))
query("sec.deprecate_policy", "SELECT id, id % 10 = 3 AS deprecated, CASE WHEN id % 20 = 3 THEN id + 1 END AS superseded_by FROM tasks")(
    lambda v: v.tasks.select("id", (F.col("id") % 10 == 3).alias("deprecated"), F.when(F.col("id") % 20 == 3, F.col("id") + 1).alias("superseded_by")))
query("sec.attach_channel", "SELECT DISTINCT scope_id, tier FROM windows WHERE tier = 'channel'")(lambda v: where_equal(v.windows, tier="channel").select("scope_id", "tier").distinct())
query("sec.attach_domain", "SELECT DISTINCT scope_id, tier FROM windows WHERE tier = 'domain'")(lambda v: where_equal(v.windows, tier="domain").select("scope_id", "tier").distinct())

# ---- thin reads and mutations of objects

query("sec.mem_read", "SELECT id, state, sensitivity FROM memory WHERE id = '7-view'")(lambda v: where_equal(v.memory, id="7-view").select("id", "state", "sensitivity"))
query("sec.mem_list", "SELECT id FROM memory WHERE state = 'candidate'")(lambda v: where_equal(v.memory, state="candidate").select("id"))
query("sec.mem_pin", "SELECT m.id, m.pin_count + count(s.source) AS pin_count FROM memory m LEFT JOIN memory_sources s ON s.id = m.id GROUP BY m.id, m.pin_count")(
    lambda v: v.memory.select("id", "pin_count").join(v.memory_sources.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", (F.col("pin_count") + F.coalesce("n", F.lit(0))).alias("pin_count")))
query("sec.mem_unpin", "SELECT m.id, greatest(m.pin_count - count(s.source), 0) AS pin_count FROM memory m LEFT JOIN memory_sources s ON s.id = m.id GROUP BY m.id, m.pin_count")(
    lambda v: v.memory.select("id", "pin_count").join(v.memory_sources.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.greatest(F.col("pin_count") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("pin_count")))
query("sec.mem_forget", "SELECT id, CASE WHEN scope_id = '3' OR scope_id = '10' THEN 'deleted' ELSE state END AS state FROM memory WHERE scope_id NOT IN ('3', '10') OR state = 'canonical'")(
    lambda v: v.memory.where("scope_id NOT IN ('3', '10') OR state = 'canonical'").select("id", F.when(F.col("scope_id").isin("3", "10"), "deleted").otherwise(F.col("state")).alias("state")))
query("sec.mem_record_retrieval", "SELECT id, count(*) AS retrieval_count, max(moment) AS last_accessed_at FROM memory_sources GROUP BY id")(lambda v: v.memory_sources.groupBy("id").agg(F.count("*").alias("retrieval_count"), F.max("moment").alias("last_accessed_at")))
query("sec.mem_record_corroboration", "SELECT id, count(*) AS corroborations FROM memory_sources GROUP BY id")(lambda v: v.memory_sources.groupBy("id").agg(F.count("*").alias("corroborations")))
query("sec.policy_events", "SELECT scope_id, action AS event, max(moment) AS moment FROM audit GROUP BY 1, 2")(lambda v: v.audit.groupBy("scope_id", F.col("action").alias("event")).agg(F.max("moment").alias("moment")))
query("sec.policy_clear_event", "SELECT scope_id, event FROM (SELECT scope_id, arg_max(action, (moment, id)) AS event FROM audit GROUP BY scope_id) WHERE event <> 'error'")(
    lambda v: latest(v.audit.select("scope_id", F.col("action").alias("event"), "moment", "id"), ["scope_id"], ["moment", "id"]).where("event <> 'error'").select("scope_id", "event"))
query("sec.legal_hold", "SELECT id, state = 'canonical' AND 1706745600 < created_at + 2592000 AS held FROM memory")(lambda v: v.memory.select("id", ((F.col("state") == "canonical") & (AS_OF < F.col("created_at") + 30 * mem.DAY)).alias("held")))
query("sec.quality_rate", "SELECT scope_id, round(least(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (WHERE retrieval_count > 3) / count(*) END, 1.0), 6) AS rate FROM memory GROUP BY scope_id")(
    lambda v: v.memory.groupBy("scope_id").agg(F.round(F.least(F.count_if(F.col("retrieval_count") > 3) / F.count("*"), F.lit(1.0)), 6).alias("rate")))
query("lc.forget_scope", "SELECT 'memory' AS place, count(*) AS n FROM memory WHERE scope_id <> '3' UNION ALL SELECT 'ring', count(*) FROM ring WHERE scope_id <> '3' UNION ALL SELECT 'xref', count(*) FROM xref WHERE scope_id <> '3'")(
    lambda v: (lambda gone: without(v.memory, gone, ["scope_id"]).agg(F.lit("memory").alias("place"), F.count("*").alias("n")).union(without(v.ring, gone, ["scope_id"]).agg(F.lit("ring"), F.count("*"))).union(without(v.xref, gone, ["scope_id"]).agg(F.lit("xref"), F.count("*"))))(v.memory.where("scope_id = '3'")))
query("lc.key_destroy", "SELECT scope_id, count(*) AS n FROM evidence WHERE scope_id NOT IN (SELECT scope_id FROM forgotten) GROUP BY scope_id")(lambda v: without(v.evidence, v.forgotten, ["scope_id"]).groupBy("scope_id").agg(F.count("*").alias("n")))
