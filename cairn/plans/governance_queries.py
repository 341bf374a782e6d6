"""Queries over permissions, exports, proposals, replicas and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import extraction as exr, governance as gov, metrics as met, syncing as syn
from cairn.operators.relational import count_where, latest, where_equal, without
from cairn.plans.durable import Scratch
from cairn.registry import AS_OF, query

RANK = "CASE sensitivity WHEN 'critical' THEN 3 WHEN 'important' THEN 2 WHEN 'useful' THEN 1 ELSE 0 END"
REASON = f"CASE WHEN expires_at <= 1706745600 THEN 'expired' WHEN {RANK} > 2 THEN 'sensitivity' WHEN scope_id NOT IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#2', 'Brand#3') THEN 'scope' WHEN provenance IS NULL THEN 'provenance' WHEN 1706745600 - approved_at > 25920000 THEN 'time_window' END"
SCOPES = ["Brand#1", "Brand#11", "Brand#12", "Brand#13", "Brand#2", "Brand#3"]
query("lc.export_policy", f"SELECT id, coalesce({REASON}, 'approved') AS outcome FROM concepts")(lambda v: gov.export_decision(v.concepts, AS_OF, "important", SCOPES, True, 300 * 86400).select("id", "outcome"))
query("win.export_cap", f"SELECT id, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY r IS NULL ORDER BY position) > 25 THEN 'max_concepts' ELSE 'approved' END) AS outcome FROM (SELECT *, {REASON} AS r FROM concepts)")(
    lambda v: gov.export_decision(v.concepts, AS_OF, "important", SCOPES, True, 300 * 86400, 25).select("id", "outcome"))
ACTIVE = "(bound_seconds IS NULL OR 1706745600 - granted_at < bound_seconds)"
query("flt.control_active", f"SELECT concept_id, {ACTIVE} AS active FROM controls")(lambda v: v.controls.select("concept_id", gov.active(F.col("granted_at"), F.col("bound_seconds"), AS_OF).alias("active")))
query("flt.concept_control", f"SELECT c.id, coalesce(k.ok, false) AS allowed FROM concepts c LEFT JOIN (SELECT DISTINCT concept_id, scope_id, true AS ok FROM controls WHERE profile_id = 'profile1' AND {ACTIVE}) k ON k.concept_id = c.id AND k.scope_id = c.scope_id")(
    lambda v: gov.controlled(v.concepts, v.controls, "profile1", AS_OF).select("id", "allowed"))
query("join.export_simulate", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN k.ok IS NULL THEN 'not_controlled' ELSE coalesce({REASON.replace('scope_id', 'c.scope_id')}, 'approved') END AS outcome FROM concepts c LEFT JOIN (SELECT DISTINCT concept_id, scope_id, true AS ok FROM controls WHERE profile_id = 'profile1' AND {ACTIVE}) k ON k.concept_id = c.id AND k.scope_id = c.scope_id) GROUP BY outcome")(
    lambda v: gov.export_decision(gov.controlled(v.concepts, v.controls, "profile1", AS_OF), AS_OF, "important", SCOPES, True, 300 * 86400).select(F.when(~F.col("allowed"), "not_controlled").otherwise(F.col("outcome")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")))
query("flt.summary_control", "SELECT w.id, c.concept_id IS NOT NULL AS exportable FROM windows w LEFT JOIN controls c ON c.concept_id = 'p' || substr(w.id, 2)")(
    lambda v: v.windows.select("id", F.concat(F.lit("p"), F.expr("substr(id, 2)")).alias("concept_id")).join(v.controls.select("concept_id", F.lit(True).alias("k")), "concept_id", "left").select("id", F.coalesce("k", F.lit(False)).alias("exportable")))
query("flt.workflow_control", "SELECT id, agent_id IN ('agent1', 'agent2') OR kind = 'summary' AS allowed FROM proposals")(
    lambda v: v.proposals.select("id", ((F.size(F.when(F.col("kind") == "summary", F.array()).otherwise(F.array(F.lit("agent1"), F.lit("agent2")))) == 0) | F.col("agent_id").isin("agent1", "agent2")).alias("allowed")))
query("agg.size_estimate", "SELECT scope_id, CAST(sum(octet_length(encode(label)) + octet_length(encode(definition)) + 64) AS BIGINT) AS bytes FROM concepts GROUP BY scope_id")(
    lambda v: v.concepts.groupBy("scope_id").agg(F.sum(F.octet_length("label") + F.octet_length("definition") + 64).alias("bytes")))
query("sec.approved_list", "SELECT id FROM concepts WHERE scope_id = 'Brand#13'")(lambda v: where_equal(v.concepts, scope_id="Brand#13").select("id"))
query("sec.approval_revoke", "SELECT id FROM concepts WHERE id NOT IN (SELECT concept_id FROM controls)")(lambda v: without(v.concepts, v.controls.select(F.col("concept_id").alias("id")), ["id"]).select("id"))
query("sec.approved_within", "SELECT id, 1706745600 - approved_at <= 8640000 AS inside FROM concepts")(lambda v: v.concepts.select("id", (AS_OF - F.col("approved_at") <= 100 * 86400).alias("inside")))
query("sec.export_view", f"SELECT scope_id, count(*) FILTER (WHERE {REASON} IS NULL) AS approved, coalesce(bool_or(sensitivity = 'critical'), false) AS has_critical FROM concepts GROUP BY scope_id")(
    lambda v: gov.export_decision(v.concepts, AS_OF, "important", SCOPES, True, 300 * 86400).groupBy("scope_id").agg(count_where("approved", F.col("outcome") == "approved"), F.bool_or(F.col("sensitivity") == "critical").alias("has_critical")))
query("lc.export_approve", "SELECT q.id FROM proposals q JOIN concepts c ON c.id = 'p' || substr(q.id, 2) WHERE q.status = 'promoted' AND c.provenance IS NOT NULL")(
    lambda v: v.proposals.where("status = 'promoted'").select("id", F.concat(F.lit("p"), F.expr("substr(id, 2)")).alias("c")).join(v.concepts.where("provenance IS NOT NULL").select(F.col("id").alias("c")), "c", "left_semi").select("id"))
query("set.policy_tighten", "SELECT id, least(CAST(confidence * 100 AS BIGINT), 40) AS cap FROM concepts")(lambda v: v.concepts.select("id", F.least((F.col("confidence") * 100 + F.lit(0.5)).cast("bigint") if False else F.round(F.col("confidence") * 100).cast("bigint"), F.lit(40)).alias("cap")))
query("nest.evidence_pack", "SELECT scope_id, count(*) AS concepts, md5(string_agg(id, ',' ORDER BY id)) AS digest FROM concepts GROUP BY scope_id")(lambda v: v.concepts.groupBy("scope_id").agg(F.count("*").alias("concepts"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("digest")))
query("sink.export_md", "SELECT scope_id, md5('# ' || scope_id || chr(10) || string_agg('- **' || label || '**: ' || definition, chr(10) ORDER BY id)) AS digest FROM concepts GROUP BY scope_id")(
    lambda v: v.concepts.groupBy("scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label", "definition"))), lambda c: F.concat(F.lit("- **"), c["label"], F.lit("**: "), c["definition"])), "\n").alias("b")).select("scope_id", F.md5(F.concat(F.lit("# "), "scope_id", F.lit("\n"), "b")).alias("digest")))
query("sink.export_html", "SELECT scope_id, md5('<h1>' || scope_id || '</h1>' || string_agg('<li>' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</li>', '' ORDER BY id)) AS digest FROM concepts GROUP BY scope_id")(
    lambda v: v.concepts.select("scope_id", "id", F.replace(F.replace(F.replace("label", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("l")).groupBy("scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "l"))), lambda c: F.concat(F.lit("<li>"), c["l"], F.lit("</li>"))), "").alias("b")).select("scope_id", F.md5(F.concat(F.lit("<h1>"), "scope_id", F.lit("</h1>"), "b")).alias("digest")))

# ---- proposals

ERROR = "CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_range' WHEN scope_id = '' THEN 'nil_scope' WHEN ttl_seconds = 0 THEN 'zero_ttl' WHEN trim(content) = '' THEN 'empty_content' END"
AUTO = f"(confidence >= 0.9 AND corroboration_count >= 2 AND {RANK} <= 1 AND sensitivity <> 'critical')"
query("flt.proposal_validate", f"SELECT id, {ERROR} AS error FROM proposals")(lambda v: v.proposals.select("id", gov.proposal_error().alias("error")))
query("flt.auto_promote", f"SELECT id FROM proposals WHERE {AUTO}")(lambda v: v.proposals.where(gov.auto_promotes()).select("id"))
query("lc.proposal_review", f"SELECT id, CASE WHEN status IN ('promoted', 'rejected') THEN 'invalid_transition' WHEN submitted_at + ttl_seconds <= 1706745600 THEN 'rejected_expired' WHEN status <> 'submitted' THEN 'invalid_transition' WHEN {AUTO} THEN 'auto_promoted' ELSE 'needs_human_review' END AS result FROM proposals")(
    lambda v: v.proposals.select("id", gov.review(AS_OF).alias("result")))
query("lc.proposal_corroborate", "SELECT q.id, q.corroboration_count + count(m.id) AS corroborations FROM proposals q LEFT JOIN memory_sources m ON m.source = substr(q.id, 2) WHERE q.status NOT IN ('promoted', 'rejected') GROUP BY q.id, q.corroboration_count")(
    lambda v: v.proposals.where("status NOT IN ('promoted', 'rejected')").select("id", "corroboration_count", F.expr("substr(id, 2)").alias("source")).join(v.memory_sources.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("id", (F.col("corroboration_count") + F.coalesce("n", F.lit(0))).alias("corroborations")))
query("lc.proposal_canonical", "SELECT id, kind, substr(sha1(kind || '|' || id), 1, 32) AS canonical FROM proposals WHERE status = 'promoted'")(lambda v: where_equal(v.proposals, status="promoted").select("id", "kind", F.substring(F.sha1(F.concat("kind", F.lit("|"), "id")), 1, 32).alias("canonical")))
query("sec.proposal_promote", "SELECT id, CASE WHEN status = 'under_review' THEN 'promoted' ELSE status END AS status FROM proposals")(lambda v: v.proposals.select("id", F.when(F.col("status") == "under_review", "promoted").otherwise(F.col("status")).alias("status")))
query("sec.proposal_reject", "SELECT id, CASE WHEN status IN ('promoted', 'rejected') THEN status ELSE 'rejected' END AS status FROM proposals")(lambda v: v.proposals.select("id", F.when(F.col("status").isin("promoted", "rejected"), F.col("status")).otherwise("rejected").alias("status")))
query("sec.proposal_submit", f"SELECT id FROM proposals WHERE kind = 'observation' AND {ERROR} IS NULL")(lambda v: v.proposals.where((F.col("kind") == "observation") & gov.proposal_error().isNull()).select("id"))
query("sec.proposal_expired", "SELECT id, submitted_at + ttl_seconds <= 1706745600 AS expired FROM proposals")(lambda v: v.proposals.select("id", (F.col("submitted_at") + F.col("ttl_seconds") <= AS_OF).alias("expired")))

# ---- permissions

_GIVES = " UNION ALL ".join(f"SELECT '{h}' AS held, '{g}' AS given" for h, gs in gov.IMPLIES.items() for g in gs)
query("join.permission_covering", f"SELECT t.object_id, t.subject_id, t.relation FROM tuples t JOIN ({_GIVES}) g ON g.held = t.relation WHERE g.given = 'viewer' AND t.object_type = 'scope'")(
    lambda v: v.tuples.where((F.col("object_type") == "scope") & F.col("relation").isin(gov.covering("viewer"))).select("object_id", "subject_id", "relation"))
query("graph.permission_check", f"""WITH RECURSIVE gives AS ({_GIVES}), held(object_id, type, id, relation) AS (
    SELECT t.object_id, t.subject_type, t.subject_id, t.subject_relation FROM tuples t JOIN gives g ON g.held = t.relation AND g.given = 'editor' WHERE t.object_type = 'scope'
    UNION SELECT h.object_id, t.subject_type, t.subject_id, t.subject_relation FROM held h JOIN tuples t ON t.object_type = h.type AND t.object_id = h.id JOIN gives g ON g.held = t.relation AND g.given = h.relation)
    SELECT DISTINCT object_id, id AS subject_id FROM held WHERE relation IS NULL AND type = 'user'""")(lambda v: gov.reachable(v.tuples, "scope", "editor", Scratch(v.spark, "permissions")))
query("sec.tuple_insert", "SELECT DISTINCT object_type, object_id, relation, subject_type, subject_id, subject_relation FROM tuples")(lambda v: v.tuples.union(v.tuples).distinct())
query("sec.tuple_contains", "SELECT object_id, count(*) > 0 AS present FROM tuples WHERE object_type = 'group' AND relation = 'member' AND subject_type = 'user' AND subject_id = 'user7' GROUP BY object_id")(
    lambda v: where_equal(v.tuples, object_type="group", relation="member", subject_type="user", subject_id="user7").groupBy("object_id").agg((F.count("*") > 0).alias("present")))
query("graph.community_visible", "SELECT scope_id, bool_and(state <> 'superseded') AS visible FROM nodes GROUP BY scope_id")(lambda v: v.nodes.groupBy("scope_id").agg(F.bool_and(F.col("state") != "superseded").alias("visible")))
query("join.scim_groups_of_user", "SELECT object_id AS group_id FROM tuples WHERE object_type = 'group' AND subject_id = 'user12'")(lambda v: where_equal(v.tuples, object_type="group", subject_id="user12").select(F.col("object_id").alias("group_id")))
_BEFORE, _AFTER = "SELECT object_id, subject_id FROM tuples WHERE object_type = 'group' AND subject_type = 'user' AND length(subject_id) < 6", "SELECT object_id, subject_id FROM tuples WHERE object_type = 'group' AND subject_type = 'user' AND length(subject_id) > 5"
_members = lambda v, how: v.tuples.where(f"object_type = 'group' AND subject_type = 'user' AND {how}").select("object_id", "subject_id")
query("join.scim_reconcile", f"SELECT *, 'grant' AS operation FROM ({_AFTER} EXCEPT ALL {_BEFORE}) UNION ALL SELECT *, 'revoke' FROM ({_BEFORE} EXCEPT ALL {_AFTER})")(lambda v: gov.difference(_members(v, "length(subject_id) < 6"), _members(v, "length(subject_id) > 5")))
query("join.scim_role_reconcile", "SELECT relation, 'grant' AS operation FROM (SELECT DISTINCT relation FROM tuples WHERE object_type = 'scope' EXCEPT SELECT 'viewer') UNION ALL SELECT 'admin', 'revoke'")(
    lambda v: gov.difference(v.spark.sql("SELECT 'viewer' AS relation UNION ALL SELECT 'admin'"), v.tuples.where("object_type = 'scope'").select("relation").distinct()))
query("sec.scim_user_ops", "SELECT object_type, object_id, relation FROM tuples WHERE subject_type = 'user' AND subject_id = 'user9'")(lambda v: where_equal(v.tuples, subject_type="user", subject_id="user9").select("object_type", "object_id", "relation"))
query("sec.scim_list", "SELECT DISTINCT subject_id FROM tuples WHERE subject_type = 'user'")(lambda v: where_equal(v.tuples, subject_type="user").select("subject_id").distinct())
query("sec.acl_level_map", "SELECT DISTINCT relation, CASE relation WHEN 'owner' THEN 'owner' WHEN 'editor' THEN 'write' ELSE 'read' END AS level FROM tuples")(lambda v: v.tuples.select("relation", F.when(F.col("relation") == "owner", "owner").when(F.col("relation") == "editor", "write").otherwise("read").alias("level")).distinct())
query("join.acl_grant", "SELECT a.id, a.actor, CASE WHEN t.subject_id IS NULL THEN 'unknown_user' ELSE 'granted' END AS outcome FROM audit a LEFT JOIN (SELECT DISTINCT subject_id FROM tuples WHERE subject_type = 'user') t ON t.subject_id = a.actor WHERE a.action = 'signup'")(
    lambda v: v.audit.where("action = 'signup'").select("id", "actor").join(where_equal(v.tuples, subject_type="user").select(F.col("subject_id").alias("actor"), F.lit(True).alias("k")).distinct(), "actor", "left").select("id", "actor", F.when(F.col("k"), "granted").otherwise("unknown_user").alias("outcome")))
query("join.acl_revoke", "SELECT object_id, subject_id FROM tuples t WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.action = 'error' AND a.actor = t.subject_id)")(
    lambda v: v.tuples.join(v.audit.where("action = 'error'").select(F.col("actor").alias("subject_id")).distinct(), "subject_id", "left_anti").select("object_id", "subject_id"))
query("join.acl_sync", "SELECT scope_id, actor, action FROM audit WHERE action IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY scope_id, actor ORDER BY moment DESC, id DESC) = 1")(
    lambda v: gov.last_change(v.audit.where("action IN ('signup', 'error')"), ["scope_id", "actor"], ["moment", "id"]).select("scope_id", "actor", "action"))
query("sec.tenant_suspend", "SELECT tenant_id, CASE WHEN arg_max(action, (moment, id)) = 'error' THEN 'suspended' ELSE 'active' END AS status, min(moment) FILTER (WHERE action = 'error') AS first_suspended FROM audit WHERE action IN ('error', 'signup') GROUP BY tenant_id")(
    lambda v: gov.tenant_status(v.audit.where("action IN ('error', 'signup')").select("tenant_id", F.when(F.col("action") == "error", "suspend").otherwise("resume").alias("kind"), "moment", "id")))
query("sec.tenant_members", "SELECT DISTINCT tenant_id, actor FROM audit WHERE tenant_id = '2'")(lambda v: where_equal(v.audit, tenant_id="2").select("tenant_id", "actor").distinct())
query("sec.tenant_role", "SELECT actor, arg_max(action, (moment, id)) AS role FROM audit GROUP BY actor")(lambda v: latest(v.audit.select("actor", F.col("action").alias("role"), "moment", "id"), ["actor"], ["moment", "id"]).select("actor", "role"))
query("sec.tenant_list", "SELECT tenant_id, min(moment) AS created_at FROM audit GROUP BY tenant_id")(lambda v: v.audit.groupBy("tenant_id").agg(F.min("moment").alias("created_at")))

# ---- replicas

ADDS = "(SELECT DISTINCT value, tag FROM op_log WHERE kind = 'add' AND tag NOT IN (SELECT observed_tag FROM op_log WHERE kind = 'remove' AND observed_tag IS NOT NULL))"
query("set.crdt_elements", f"SELECT DISTINCT value FROM {ADDS}")(lambda v: syn.elements(v.op_log))
query("agg.crdt_count", f"SELECT count(DISTINCT value) AS n FROM {ADDS}")(lambda v: syn.elements(v.op_log).agg(F.count("*").alias("n")))
query("set.crdt_entries", f"SELECT value, count(*) AS tags, min(tag) AS first_tag FROM {ADDS} GROUP BY value")(lambda v: syn.entries(v.op_log))
query("set.crdt_merge", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT replica, seq, kind FROM op_log) GROUP BY kind")(lambda v: syn.merge_logs(v.op_log.where("replica < 3"), v.op_log.where("replica > 0")).groupBy("kind").agg(F.count("*").alias("n")))
query("set.oplog_merge", "SELECT DISTINCT replica, seq FROM op_log")(lambda v: syn.merge_logs(v.op_log, v.op_log).select("replica", "seq"))
query("set.merge_logs", "SELECT replica, max(seq) AS seq FROM op_log GROUP BY replica")(lambda v: syn.merge_logs(v.op_log.where("seq % 2 = 0"), v.op_log).groupBy("replica").agg(F.max("seq").alias("seq")))
query("set.delta_since", "SELECT replica, seq FROM op_log WHERE replica <> 2 OR seq > 100")(lambda v: syn.delta_since(v.op_log, 2, 100).select("replica", "seq"))
query("set.delta_own", "SELECT replica, seq FROM op_log WHERE replica = 2 AND seq > 100")(lambda v: v.op_log.where("replica = 2 AND seq > 100").select("replica", "seq"))
query("st.oplog_replay", f"SELECT 'add' AS kind, value, tag FROM {ADDS} UNION ALL SELECT 'supersede', value, successor FROM op_log WHERE kind = 'supersede'")(
    lambda v: syn.live_adds(v.op_log).select(F.lit("add").alias("kind"), "value", "tag").union(v.op_log.where("kind = 'supersede'").select(F.lit("supersede"), "value", "successor")))
query("st.oplog_compact", f"SELECT replica, seq, kind FROM op_log WHERE kind = 'supersede' OR (kind = 'add' AND tag IN (SELECT tag FROM {ADDS}))")(lambda v: syn.compact(v.op_log).select("replica", "seq", "kind"))
query("st.apply_delta", "SELECT replica, seq FROM op_log WHERE replica = 1 OR seq <= 50")(lambda v: syn.merge_logs(where_equal(v.op_log, replica=1), v.op_log.where("seq <= 50")).select("replica", "seq"))
query("st.merge_engine", "SELECT replica, count(*) AS ops, count(*) FILTER (WHERE kind = 'remove') AS tombstones FROM op_log GROUP BY replica")(lambda v: syn.merge_logs(v.op_log, v.op_log).groupBy("replica").agg(F.count("*").alias("ops"), count_where("tombstones", F.col("kind") == "remove")))
query("st.compaction_trigger", "SELECT replica, count(*) > 100 AND (count(*) FILTER (WHERE kind = 'remove') / count(*) > 0.1 OR count(*) > 4194304) AS due FROM op_log GROUP BY replica")(
    lambda v: v.op_log.groupBy("replica").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "remove").alias("t")).select("replica", ((F.col("n") > 100) & ((F.col("t") / F.col("n") > 0.1) | (F.col("n") > 4194304))).alias("due")))
query("sec.crdt_contains", f"SELECT DISTINCT value, true AS live FROM {ADDS} WHERE value IN ('1', '2', '3')")(lambda v: syn.elements(v.op_log).where(F.col("value").isin("1", "2", "3")).withColumn("live", F.lit(True)))
query("sec.crdt_remove", f"SELECT value, tag FROM {ADDS} WHERE value = '5'")(lambda v: where_equal(syn.live_adds(v.op_log), value="5"))
query("sec.engine_state", f"SELECT value, count(*) AS tags FROM {ADDS} GROUP BY value")(lambda v: syn.entries(v.op_log).select("value", "tags"))
query("agg.relay_paging", "SELECT replica, seq, tag FROM op_log WHERE replica = 0 AND seq > 40 ORDER BY seq LIMIT 25")(lambda v: v.op_log.where("replica = 0 AND seq > 40").orderBy("seq").limit(25).select("replica", "seq", "tag"))
query("st.watermark_observe", "SELECT scope_id, m AS mark, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS boundary FROM (SELECT *, max(moment) OVER (PARTITION BY scope_id) AS m FROM audit) WHERE moment = m GROUP BY 1, 2")(
    lambda v: syn.watermark(v.audit, ["scope_id"], "moment", "id").select("scope_id", "mark", F.array_join("boundary", ",").alias("boundary")))
query("st.watermark_parse", "SELECT scope_id, max(moment) AS mark, 1 AS ids FROM audit GROUP BY scope_id")(
    lambda v: v.audit.groupBy("scope_id").agg(F.concat(F.max("moment").cast("string"), F.lit("|7")).alias("c")).select("scope_id", syn.cursor_parse(F.col("c")).alias("p")).select("scope_id", "p.mark", "p.ids"))
query("st.change_events", "SELECT document_id, kind, occurred_at FROM source_events QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY occurred_at DESC, event_id DESC) = 1 AND kind <> 'deleted'")(lambda v: syn.current_documents(v.source_events).select("document_id", "kind", "occurred_at"))
query("st.dedup_success", "SELECT DISTINCT window_id FROM versions")(lambda v: v.versions.select("window_id").dropDuplicates())
query("sec.attach_connector", "SELECT DISTINCT scope_id, action AS kind FROM audit")(lambda v: v.audit.select("scope_id", F.col("action").alias("kind")).distinct())
query("sec.attachments_for", "SELECT DISTINCT action AS kind FROM audit WHERE scope_id = '4'")(lambda v: where_equal(v.audit, scope_id="4").select(F.col("action").alias("kind")).distinct())

# ---- operations

BUCKET = "CASE " + " ".join(f"WHEN seconds <= {b} THEN {i}" for i, b in enumerate(met.BOUNDS)) + f" ELSE {len(met.BOUNDS)} END"
HIST = f"(SELECT tenant_id, {BUCKET} AS bucket, count(*) AS n FROM requests GROUP BY 1, 2)"
query("agg.hist_record", f"SELECT tenant_id, bucket, n FROM {HIST}")(lambda v: met.histogram(v.requests, ["tenant_id"]))
query("agg.hist_cumulative", f"SELECT tenant_id, bucket, CAST(sum(n) OVER (PARTITION BY tenant_id ORDER BY bucket) AS BIGINT) AS cumulative FROM {HIST}")(lambda v: met.cumulative(met.histogram(v.requests, ["tenant_id"]), ["tenant_id"]).select("tenant_id", "bucket", "cumulative"))
query("agg.hist_merge", f"SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM {HIST} GROUP BY bucket")(lambda v: met.histogram(v.requests, ["tenant_id"]).groupBy("bucket").agg(F.sum("n").alias("n")))
query("sec.overall_latency", "SELECT count(*) AS n, round(sum(seconds), 4) AS total FROM requests")(lambda v: v.requests.agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("total")))
query("sec.dispatch_latency", f"SELECT route, {BUCKET} AS bucket, count(*) AS n FROM requests GROUP BY 1, 2")(lambda v: met.histogram(v.requests, ["route"]))
_LOW = "[0.0, " + ", ".join(map(str, met.BOUNDS)) + "]"
query("agg.hist_quantile", f"""SELECT tenant_id, round(CASE WHEN bucket = 15 THEN 60.0 ELSE {_LOW}[bucket + 1] + ({_LOW}[bucket + 2] - {_LOW}[bucket + 1]) * (rank - (cum - n)) / n END, 6) AS quantile FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY bucket) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY tenant_id ORDER BY bucket) AS cum, 0.95 * sum(n) OVER (PARTITION BY tenant_id) AS rank FROM {HIST}) WHERE cum >= rank) WHERE k = 1""")(
    lambda v: met.quantile(met.histogram(v.requests, ["tenant_id"]), ["tenant_id"], 0.95).select("tenant_id", F.round("quantile", 6).alias("quantile")))
ROUTE = "CASE WHEN route = '/api/v1/query' OR starts_with(route, '/api/v1/query/') THEN 'query' WHEN starts_with(route, '/api/v1/evidence') THEN 'evidence' WHEN starts_with(route, '/api/v1/synthesis') THEN 'synthesis' ELSE 'other' END"
OUTCOME = "CASE WHEN status >= 500 THEN 'error' WHEN status = 429 THEN 'throttled' ELSE 'ok' END"
query("agg.slo_route_class", f"SELECT {ROUTE} AS class, count(*) AS n FROM requests GROUP BY 1")(lambda v: v.requests.groupBy(met.route_class(F.col("route")).alias("class")).agg(F.count("*").alias("n")))
query("agg.slo_outcomes", f"SELECT {ROUTE} AS class, tenant_id, {OUTCOME} AS outcome, count(*) AS n FROM requests GROUP BY 1, 2, 3")(lambda v: v.requests.groupBy(met.route_class(F.col("route")).alias("class"), "tenant_id", met.outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n")))
query("agg.tenant_cardinality_cap", "SELECT CASE WHEN k <= 20 THEN tenant_id ELSE 'overflow' END AS label, count(*) AS n FROM requests JOIN (SELECT tenant_id, row_number() OVER (ORDER BY min((moment, id)), tenant_id) AS k FROM requests GROUP BY tenant_id) USING (tenant_id) GROUP BY 1")(
    lambda v: met.capped_label(v.requests, "tenant_id", ["moment", "id"], 20).groupBy("label").agg(F.count("*").alias("n")))
query("agg.telemetry_totals", "SELECT CAST(sum(retrieval_count) AS BIGINT) AS queries, CAST(sum(corroboration_count) AS BIGINT) AS rows_returned FROM memory")(lambda v: v.memory.agg(F.sum("retrieval_count").alias("queries"), F.sum("corroboration_count").alias("rows_returned")))
query("agg.telemetry_delta", "SELECT tenant_id, count(*) FILTER (WHERE moment >= 1705000000) - count(*) FILTER (WHERE moment < 1705000000) AS delta FROM requests GROUP BY tenant_id")(
    lambda v: v.requests.groupBy("tenant_id").agg((F.count_if(F.col("moment") >= 1705000000) - F.count_if(F.col("moment") < 1705000000)).alias("delta")))
query("agg.sim_per_tenant", "SELECT tenant_id, language, scenario_id, count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM turns GROUP BY GROUPING SETS ((tenant_id), (language), (scenario_id))")(
    lambda v: v.turns.groupingSets([[F.col("tenant_id")], [F.col("language")], [F.col("scenario_id")]], F.col("tenant_id"), F.col("language"), F.col("scenario_id")).agg(F.count("*").alias("n"), count_where("passed", F.col("passed"))))
query("agg.leaderboard", "SELECT language, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM turns GROUP BY language")(lambda v: v.turns.groupBy("language").agg(F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 6).alias("coverage")))
_JUDGED = "(SELECT scenario_id AS expected, CASE WHEN passed THEN scenario_id WHEN id % 2 = 0 THEN 'view' ELSE 'unheard' END AS predicted FROM turns)"
_COUNTS = f"(SELECT k AS kind, count(*) FILTER (WHERE w AND expected = predicted) AS tp, count(*) FILTER (WHERE NOT w AND expected <> predicted) AS fp, count(*) FILTER (WHERE w AND expected <> predicted) AS fn FROM (SELECT expected AS k, true AS w, * FROM {_JUDGED} UNION ALL SELECT predicted, false, * FROM {_JUDGED}) GROUP BY k)"
_PRF = f"(SELECT kind, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT kind, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM {_COUNTS}))"


def judged(v):
    """Expected kinds beside predicted ones; one kind is only ever predicted."""
    return exr.confusion(v.turns.select(F.col("scenario_id").alias("expected"), F.when(F.col("passed"), F.col("scenario_id")).when(F.col("id") % 2 == 0, "view").otherwise("unheard").alias("predicted")), "expected", "predicted")


query("agg.prf", f"SELECT kind, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_PRF}")(lambda v: exr.scores(judged(v)).select("kind", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]))
query("agg.macro_f1", f"SELECT round(avg(f1), 6) AS macro FROM {_PRF}")(lambda v: exr.macro_f1(judged(v)).select(F.round("macro", 6).alias("macro")))
query("fn.retry_after", "SELECT id, greatest(CAST(ceil(seconds) AS BIGINT), 1) AS retry_after FROM requests")(lambda v: v.requests.select("id", F.greatest(F.ceil("seconds"), F.lit(1)).alias("retry_after")))
query("fn.quota_normalise", "SELECT id, CASE WHEN status - 300 <= 0 THEN 60 ELSE status - 300 END AS quota FROM requests")(lambda v: v.requests.select("id", F.when(F.col("status") - 300 <= 0, 60).otherwise(F.col("status") - 300).alias("quota")))
query("fn.sync_backoff", "SELECT id, least(30 * pow(2, id % 9), 3600) AS delay FROM requests")(lambda v: v.requests.select("id", F.least(30 * F.pow(F.lit(2.0), F.col("id") % 9), F.lit(3600.0)).alias("delay")))
query("sec.audit_record", "SELECT sequence, id, action FROM audit WHERE action = 'purchase'")(lambda v: where_equal(v.audit, action="purchase").select("sequence", "id", "action"))
query("sec.storage_soft_cap", "SELECT scope_id, sum(size_bytes) > 100000 AS over FROM evidence GROUP BY scope_id")(lambda v: v.evidence.groupBy("scope_id").agg((F.sum("size_bytes") > 100000).alias("over")))
query("sec.sim_isolation", "SELECT scope_id, count(*) AS leaks FROM evidence e JOIN (SELECT content_hash, arg_min(scope_id, (created_at, evidence_id)) AS home FROM evidence GROUP BY 1) h USING (content_hash) WHERE scope_id <> home GROUP BY scope_id")(
    lambda v: gov.leaks(v.evidence))
query("sec.provider_key", "SELECT DISTINCT split_part(split_part(source_url, '://', 2), '/', 1) AS host FROM citations")(lambda v: v.citations.select(F.substring_index(F.substring_index("source_url", "://", -1), "/", 1).alias("host")).distinct())
