"""Queries over the evidence store: scans, sinks, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import evidence as ev
from cairn.operators.relational import count_where, latest, numbered, page, top_per, where_equal, without
from cairn.plans.durable import Scratch
from cairn.registry import AS_OF, query

ROUTE = "CASE WHEN importance = 0 THEN 'ring_buffer' WHEN size_bytes <= 512 THEN 'inline' ELSE 'body_table' END"

# ---- scans

query("scan.evidence_point", "SELECT evidence_id, scope_id, content_hash, importance, created_at FROM evidence WHERE evidence_id = 42")(
    lambda v: where_equal(v.evidence, evidence_id=42).select("evidence_id", "scope_id", "content_hash", "importance", "created_at"))
query("scan.evidence_body", f"SELECT evidence_id, CASE {ROUTE} WHEN 'ring_buffer' THEN NULL ELSE md5(body) END AS body_md5, {ROUTE} AS storage_path FROM evidence")(
    lambda v: ev.read_body(v.evidence, ev.body_store(v.evidence)).select("evidence_id", F.md5("body").alias("body_md5"), "storage_path"))
query("scan.recent_by_scope", "SELECT evidence_id, scope_id, created_at FROM evidence QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, evidence_id DESC) <= 5")(
    lambda v: ev.recent(v.evidence, 5).select("evidence_id", "scope_id", "created_at"))
query("scan.embeddings", "SELECT evidence_id, list_sum(embedding) > 0 AS positive, len(embedding) AS dimension FROM evidence_vec WHERE model_tag = 'm0'")(
    lambda v: where_equal(v.evidence_vec, model_tag="m0").select("evidence_id", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) > 0).alias("positive"), F.size("embedding").cast("bigint").alias("dimension")))
query("scan.embeddings_by_model", "SELECT evidence_id, model_tag, len(embedding) AS dimension FROM evidence_vec WHERE evidence_id IN (7, 8, 9, 10) AND model_tag = 'm1'")(
    lambda v: where_equal(v.evidence_vec, model_tag="m1").where(F.col("evidence_id").isin(7, 8, 9, 10)).select("evidence_id", "model_tag", F.size("embedding").cast("bigint").alias("dimension")))
query("scan.ring_window", "SELECT id, scope_id, payload_size, created_at FROM ring WHERE scope_id = '7'")(
    lambda v: where_equal(v.ring, scope_id="7").orderBy("created_at", "id").select("id", "scope_id", "payload_size", "created_at"))
query("scan.find_by_reference", "SELECT evidence_id, created_at FROM xref WHERE ref_key = 'user' AND ref_value = '7'")(
    lambda v: ev.find_by_reference(v.xref, "user", "7").select("evidence_id", "created_at"))
query("scan.refs_of", "SELECT ref_key, ref_value FROM xref WHERE evidence_id = 12")(lambda v: ev.references_of(v.xref, 12))
query("scan.forgotten_scopes", "SELECT scope_id FROM forgotten")(lambda v: v.forgotten.select("scope_id"))
query("scan.forgotten_scopes_ts", "SELECT scope_id, forgotten_at FROM forgotten")(lambda v: v.forgotten.select("scope_id", "forgotten_at"))
query("scan.epoch_tombstones", "SELECT scope_id, epoch_id, forgotten_at FROM epoch_tombstones")(lambda v: v.epoch_tombstones)
query("scan.memory_scopes", "SELECT DISTINCT scope_id FROM memory WHERE observation_type = 'purchase'")(
    lambda v: where_equal(v.memory, observation_type="purchase").select("scope_id").distinct())
query("scan.synth_versions", "SELECT version, created_at FROM versions WHERE scope_id = 'c7' AND window_id = 'w7'")(
    lambda v: where_equal(v.versions, scope_id="c7", window_id="w7").orderBy("version").select("version", "created_at"))
query("scan.synth_version", "SELECT scope_id, window_id, version, recap FROM versions WHERE scope_id = 'c7' AND window_id = 'w7' AND version = 1")(
    lambda v: where_equal(v.versions, scope_id="c7", window_id="w7", version=1).select("scope_id", "window_id", "version", "recap"))
query("scan.synth_version_keys", "SELECT DISTINCT scope_id, window_id FROM versions")(lambda v: v.versions.select("scope_id", "window_id").distinct())
query("scan.approved_docs_meta", "SELECT document_id, content_hash, size_bytes FROM approved_docs WHERE scope_id = 3")(
    lambda v: where_equal(v.approved_docs, scope_id=3).select("document_id", "content_hash", "size_bytes"))
query("scan.approved_doc_keys", "SELECT scope_id, document_id FROM approved_docs")(lambda v: v.approved_docs.select("scope_id", "document_id"))
query("scan.graph_load_scope", "SELECT 'node' AS kind, id FROM nodes WHERE scope_id = 's1' UNION ALL SELECT 'edge', id FROM edges WHERE scope_id = 's1'")(
    lambda v: where_equal(v.nodes, scope_id="s1").select(F.lit("node").alias("kind"), "id").union(where_equal(v.edges, scope_id="s1").select(F.lit("edge"), "id")))
query("scan.graph_paginated", "SELECT id, created_at FROM nodes WHERE scope_id = 's1' ORDER BY created_at, id LIMIT 20 OFFSET 10")(
    lambda v: page(where_equal(v.nodes, scope_id="s1"), [F.col("created_at"), F.col("id")], 10, 20).select("id", "created_at"))
query("scan.graph_neighbors_disk", "SELECT id, src, dst, relation FROM edges WHERE src = 'n3' OR dst = 'n3'")(
    lambda v: v.edges.where("src = 'n3' OR dst = 'n3'").select("id", "src", "dst", "relation"))
query("scan.audit_load", "SELECT sequence, id, actor, action, scope_id, moment FROM audit")(lambda v: v.audit.select("sequence", "id", "actor", "action", "scope_id", "moment").orderBy("sequence"))

# ---- sinks

query("sink.ingest", f"SELECT evidence_id, size_bytes, importance, {ROUTE} AS storage_path FROM evidence")(lambda v: ev.ingest(v.evidence).select("evidence_id", "size_bytes", "importance", "storage_path"))
query("sink.ingest_lang", f"SELECT evidence_id, language_tag, {ROUTE} AS storage_path FROM evidence")(lambda v: ev.ingest(v.evidence).select("evidence_id", "language_tag", "storage_path"))
query("sink.ingest_body_table", f"SELECT content_hash, md5(min(body)) AS body_md5, count(*) AS ref_count FROM evidence WHERE {ROUTE} = 'body_table' GROUP BY content_hash")(
    lambda v: ev.body_store(v.evidence).select("content_hash", F.md5("body").alias("body_md5"), "ref_count"))
query("sink.ingest_refs", "SELECT x.evidence_id, x.ref_key, x.ref_value FROM xref x JOIN evidence e ON e.evidence_id = x.evidence_id WHERE e.importance > 0")(
    lambda v: v.xref.join(v.evidence.where("importance > 0").select("evidence_id"), "evidence_id").select("evidence_id", "ref_key", "ref_value"))
query("sink.embedding_dedup_copy", """SELECT e.evidence_id, k.model_tag, k.copied_from FROM evidence e JOIN (SELECT content_hash, model_tag, min(evidence_id) AS copied_from FROM evidence_vec GROUP BY 1, 2) k ON k.content_hash = e.content_hash
    WHERE e.evidence_id NOT IN (SELECT evidence_id FROM evidence_vec)""")(lambda v: ev.embedding_copies(v.evidence_vec, v.evidence).select("evidence_id", "model_tag", "copied_from"))
query("sink.xref_add", "SELECT DISTINCT evidence_id, ref_key, ref_value FROM (SELECT evidence_id, ref_key, ref_value FROM xref UNION ALL SELECT evidence_id, 'kind', ref_key FROM xref)")(
    lambda v: ev.add_references(v.xref, v.xref.select("evidence_id", F.lit("kind").alias("ref_key"), F.col("ref_key").alias("ref_value"))))
query("sink.reclassify", "SELECT evidence_id, new_importance, overridden_at FROM (SELECT * FROM overrides UNION ALL SELECT evidence_id, 3, overridden_at + 60 FROM overrides WHERE evidence_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY overridden_at DESC) = 1")(
    lambda v: latest(v.overrides.union(v.overrides.where("evidence_id % 3 = 0").select("evidence_id", F.lit(3), F.col("overridden_at") + 60)), ["evidence_id"], ["overridden_at"]))
query("sink.ring_insert", "SELECT id, scope_id FROM (SELECT *, sum(payload_size) OVER (PARTITION BY scope_id ORDER BY priority DESC, last_accessed_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s FROM ring) WHERE s <= 2048")(
    lambda v: ev.ring_evict(v.ring, 2048).select("id", "scope_id"))
query("win.ring_evict", "SELECT scope_id, count(*) AS kept, CAST(sum(payload_size) AS BIGINT) AS bytes FROM (SELECT *, sum(payload_size) OVER (PARTITION BY scope_id ORDER BY priority DESC, last_accessed_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s FROM ring) WHERE s <= 1024 GROUP BY scope_id")(
    lambda v: ev.ring_evict(v.ring, 1024).groupBy("scope_id").agg(F.count("*").alias("kept"), F.sum("payload_size").alias("bytes")))
query("sink.ring_promote", "SELECT 'ring' AS place, id FROM ring WHERE id % 10 <> 3 OR id > 500 UNION ALL SELECT 'evidence', id FROM ring WHERE id % 10 = 3 AND id <= 500")(
    lambda v: (lambda pair: pair[0].select(F.lit("ring").alias("place"), "id").union(pair[1].select(F.lit("evidence"), "evidence_id")))(ev.ring_promote(v.ring, v.evidence, list(range(3, 501, 10)), 1)))
query("sink.ring_touch", "SELECT id, CASE WHEN id IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 1706745600 ELSE last_accessed_at END AS last_accessed_at FROM ring")(
    lambda v: ev.ring_touch(v.ring, list(range(1, 10)), AS_OF).select("id", "last_accessed_at"))
query("sink.ring_priority", "SELECT id, CASE WHEN id IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 9 ELSE priority END AS priority FROM ring")(
    lambda v: ev.ring_priority(v.ring, list(range(1, 10)), 9).select("id", "priority"))
query("sink.purge_fts_scope", "SELECT evidence_id, scope_id FROM evidence WHERE scope_id <> 'src3'")(lambda v: v.evidence.where("scope_id <> 'src3'").select("evidence_id", "scope_id"))
query("sink.purge_fts_scopes", "SELECT evidence_id, scope_id FROM evidence WHERE scope_id NOT IN (SELECT scope_id FROM forgotten)")(lambda v: ev.forget_scopes(v.evidence, v.forgotten).select("evidence_id", "scope_id"))
_WRAPS = f"(SELECT DISTINCT content_hash, scope_id FROM evidence WHERE {ROUTE} = 'body_table')"
query("sink.purge_key_wraps", f"SELECT content_hash FROM {_WRAPS} GROUP BY content_hash HAVING count(*) FILTER (WHERE scope_id NOT IN (SELECT scope_id FROM forgotten)) = 0")(
    lambda v: ev.purge_wraps(ev.key_wraps(v.evidence), v.forgotten)[1])
query("sink.purge_orphans", f"SELECT content_hash, ref_count FROM (SELECT content_hash, count(*) AS ref_count FROM evidence WHERE {ROUTE} = 'body_table' GROUP BY 1) WHERE content_hash IN (SELECT content_hash FROM {_WRAPS} WHERE scope_id NOT IN (SELECT scope_id FROM forgotten))")(
    lambda v: ev.body_store(v.evidence).select("content_hash", "ref_count").join(ev.purge_wraps(ev.key_wraps(v.evidence), v.forgotten)[0].select("content_hash").distinct(), "content_hash", "left_semi"))
query("sink.count_orphans", f"SELECT count(*) AS orphans FROM (SELECT content_hash FROM {_WRAPS} GROUP BY content_hash HAVING count(*) FILTER (WHERE scope_id NOT IN (SELECT scope_id FROM forgotten)) = 0)")(
    lambda v: ev.orphans(ev.body_store(v.evidence), ev.forget_scopes(ev.key_wraps(v.evidence), v.forgotten)).agg(F.count("*").alias("orphans")))
query("join.orphans_anti", f"SELECT content_hash FROM {_WRAPS} GROUP BY content_hash HAVING count(*) FILTER (WHERE scope_id NOT IN (SELECT scope_id FROM forgotten)) = 0")(
    lambda v: ev.orphans(ev.body_store(v.evidence), ev.forget_scopes(ev.key_wraps(v.evidence), v.forgotten)).select("content_hash"))
query("sink.save_synth_version", "SELECT scope_id, window_id, version, max(recap) AS recap FROM versions GROUP BY 1, 2, 3")(
    lambda v: latest(v.versions.select("scope_id", "window_id", "version", "recap"), ["scope_id", "window_id", "version"], ["recap"]))
query("sink.trim_oldest_version", "SELECT scope_id, window_id, version FROM versions QUALIFY row_number() OVER (PARTITION BY scope_id, window_id ORDER BY version DESC) <= 3")(
    lambda v: top_per(v.versions, ["scope_id", "window_id"], [F.desc("version")], 3).select("scope_id", "window_id", "version"))
query("sink.save_approved_doc", "SELECT content_hash, count(*) AS ref_count, min(size_bytes) AS size_bytes FROM approved_docs GROUP BY content_hash")(
    lambda v: v.approved_docs.groupBy("content_hash").agg(F.count("*").alias("ref_count"), F.min("size_bytes").alias("size_bytes")))
query("sink.record_tombstone", "SELECT scope_id, min(forgotten_at) AS forgotten_at FROM (SELECT scope_id, forgotten_at FROM forgotten UNION ALL SELECT scope_id, forgotten_at FROM epoch_tombstones) GROUP BY scope_id")(
    lambda v: ev.record_tombstones(v.forgotten, v.epoch_tombstones))
query("sec.epoch_tombstone", "SELECT scope_id, epoch_id, min(forgotten_at) AS forgotten_at FROM epoch_tombstones GROUP BY 1, 2")(
    lambda v: ev.record_tombstones(v.epoch_tombstones, v.epoch_tombstones, ("scope_id", "epoch_id")))
query("sink.audit_append", "SELECT row_number() OVER (ORDER BY moment, id) AS sequence, id FROM audit")(lambda v: numbered(v.audit, ["moment", "id"], Scratch(v.spark, "sequence")).select("sequence", "id"))

# ---- filters on evidence

query("flt.storage_route", f"SELECT {ROUTE} AS storage_path, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM evidence GROUP BY 1")(
    lambda v: ev.ingest(v.evidence).groupBy("storage_path").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")))
query("flt.embed_gate", "SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{L}') THEN 'embed' ELSE 'skip' END AS route FROM texts")(
    lambda v: v.texts.select("doc_id", F.when((F.trim("text") != "") & F.col("text").rlike(r"\p{L}"), "embed").otherwise("skip").alias("route")))
query("flt.scope_forgotten", "SELECT evidence_id FROM evidence WHERE scope_id NOT IN (SELECT scope_id FROM forgotten) AND importance >= 2")(
    lambda v: ev.forget_scopes(v.evidence.where("importance >= 2"), v.forgotten).select("evidence_id"))
query("flt.citation_stale", "SELECT observation_id, 1706745600 - last_verified_at > 2592000 AS stale FROM citations")(
    lambda v: v.citations.select("observation_id", (AS_OF - F.col("last_verified_at") > 30 * 86400).alias("stale")))
query("flt.citation_stale_list", "SELECT observation_id, source_url FROM citations WHERE 1706745600 - last_verified_at > 2592000")(
    lambda v: v.citations.where(AS_OF - F.col("last_verified_at") > 30 * 86400).select("observation_id", "source_url"))
query("flt.token_expiring", "SELECT id FROM proposals WHERE submitted_at + ttl_seconds - 1706745600 <= 3600")(
    lambda v: v.proposals.where(F.col("submitted_at") + F.col("ttl_seconds") - AS_OF <= 3600).select("id"))
query("flt.watermark_emit", "SELECT id, moment FROM audit WHERE moment > (SELECT max(moment) FROM audit WHERE id <= 100) OR (moment = (SELECT max(moment) FROM audit WHERE id <= 100) AND id > 100)")(
    lambda v: (lambda mark: v.audit.where((F.col("moment") > mark) | ((F.col("moment") == mark) & (F.col("id") > 100))).select("id", "moment"))(F.lit(v.audit.where("id <= 100").agg(F.max("moment")).first()[0])))
query("flt.audit_query", "SELECT id, sequence FROM audit WHERE scope_id = '3' AND action IN ('click', 'error') AND moment >= 1704500000 AND moment <= 1706000000 AND actor = 'user3'")(
    lambda v: v.audit.where((F.col("scope_id") == "3") & F.col("action").isin("click", "error") & F.col("moment").between(1704500000, 1706000000) & (F.col("actor") == "user3")).select("id", "sequence"))
query("flt.audit_index_intersect", "SELECT sequence FROM audit WHERE scope_id = '3' INTERSECT SELECT sequence FROM audit WHERE action IN ('click', 'view') INTERSECT SELECT sequence FROM audit WHERE actor = 'user23'")(
    lambda v: v.audit.where((F.col("scope_id") == "3") & F.col("action").isin("click", "view") & (F.col("actor") == "user23")).select("sequence"))
query("flt.audit_matches", "SELECT id FROM audit WHERE tenant_id = '2' AND actor = 'user7' AND action = 'view'")(
    lambda v: where_equal(v.audit, tenant_id="2", actor="user7", action="view").select("id"))
query("flt.audit_limit", "SELECT id, sequence FROM audit ORDER BY sequence DESC LIMIT 100")(lambda v: v.audit.orderBy(F.desc("sequence")).limit(min(max(100, 1), 1000)).select("id", "sequence"))
query("win.audit_recent", "SELECT id, moment FROM audit WHERE tenant_id = '1' ORDER BY moment DESC, id DESC LIMIT 50")(lambda v: where_equal(v.audit, tenant_id="1").orderBy(F.desc("moment"), F.desc("id")).limit(50).select("id", "moment"))

# ---- joins and counts on evidence

query("join.effective_importance", "SELECT e.evidence_id, coalesce(o.new_importance, e.importance) AS effective FROM evidence e LEFT JOIN overrides o ON o.evidence_id = e.evidence_id")(
    lambda v: ev.effective_importance(v.evidence, v.overrides).select("evidence_id", "effective"))
query("join.cross_references", "SELECT DISTINCT a.evidence_id AS of, b.evidence_id FROM xref a JOIN xref b ON a.ref_key = b.ref_key AND a.ref_value = b.ref_value WHERE a.evidence_id % 100 = 0 AND a.evidence_id <> b.evidence_id")(
    lambda v: ev.cross_references(v.xref, v.xref.where("evidence_id % 100 = 0").select("evidence_id").distinct()))
query("join.embedding_copy", "SELECT v.evidence_id, v.model_tag FROM evidence_vec v JOIN evidence e ON e.evidence_id = v.evidence_id AND e.content_hash = v.content_hash WHERE v.model_tag = 'm1'")(
    lambda v: where_equal(v.evidence_vec, model_tag="m1").select("evidence_id", "content_hash", "model_tag").join(v.evidence.select("evidence_id", "content_hash"), ["evidence_id", "content_hash"]).select("evidence_id", "model_tag"))
query("agg.evidence_count", "SELECT count(*) AS n FROM evidence")(lambda v: v.evidence.agg(F.count("*").alias("n")))
query("agg.evidence_count_scope", "SELECT scope_id, count(*) AS n FROM evidence GROUP BY scope_id")(lambda v: v.evidence.groupBy("scope_id").agg(F.count("*").alias("n")))
query("agg.body_count", f"SELECT count(DISTINCT content_hash) AS n FROM evidence WHERE {ROUTE} = 'body_table'")(lambda v: ev.body_store(v.evidence).agg(F.count("*").alias("n")))
query("agg.body_refcount", f"SELECT content_hash, count(*) AS ref_count FROM evidence WHERE {ROUTE} = 'body_table' GROUP BY 1 HAVING count(*) > 1")(lambda v: ev.body_store(v.evidence).where("ref_count > 1").select("content_hash", "ref_count"))
query("agg.ring_size", "SELECT CAST(coalesce(sum(payload_size), 0) AS BIGINT) AS bytes FROM ring")(lambda v: v.ring.agg(F.coalesce(F.sum("payload_size"), F.lit(0)).alias("bytes")))
query("agg.ring_len", "SELECT count(*) AS n FROM ring")(lambda v: v.ring.agg(F.count("*").alias("n")))
query("set.scope_union", "SELECT scope_id FROM evidence UNION SELECT scope_id FROM ring UNION SELECT scope_id FROM memory UNION SELECT scope_id FROM xref UNION SELECT CAST(scope_id AS VARCHAR) FROM approved_docs UNION SELECT scope_id FROM versions UNION SELECT scope_id FROM nodes")(
    lambda v: ev.scopes_of(v.evidence, v.ring, v.memory, v.xref, v.approved_docs, v.versions, v.nodes))
query("agg.retention_delete_count", "SELECT tenant_id, count(*) FILTER (WHERE moment < 1706745600 - 86400 * (10 + CAST(tenant_id AS BIGINT))) AS expired FROM audit GROUP BY tenant_id")(
    lambda v: v.audit.groupBy("tenant_id").agg(count_where("expired", F.col("moment") < AS_OF - 86400 * (10 + F.col("tenant_id").cast("bigint")))))
query("st.retention_sweep", "SELECT id FROM audit WHERE moment >= 1706745600 - 86400 * (10 + CAST(tenant_id AS BIGINT))")(
    lambda v: v.audit.where(F.col("moment") >= AS_OF - 86400 * (10 + F.col("tenant_id").cast("bigint"))).select("id"))

# ---- deletions by scope, and thin reads

for _op, _view in (("sec.store_xref_delete", "xref"), ("sec.store_memory_delete", "memory")):
    query(_op, f"SELECT scope_id, count(*) AS n FROM {_view} WHERE scope_id <> '3' GROUP BY scope_id")(
        lambda v, view=_view: getattr(v, view).where("scope_id <> '3'").groupBy("scope_id").agg(F.count("*").alias("n")))
query("sec.store_versions_delete", "SELECT scope_id, count(*) AS n FROM versions WHERE scope_id <> 'c3' GROUP BY scope_id")(lambda v: v.versions.where("scope_id <> 'c3'").groupBy("scope_id").agg(F.count("*").alias("n")))
query("sec.store_versions_delete_window", "SELECT scope_id, window_id, version FROM versions WHERE NOT (scope_id = 'c7' AND window_id = 'w7') AND scope_id = 'c7'")(
    lambda v: v.versions.where("NOT (scope_id = 'c7' AND window_id = 'w7') AND scope_id = 'c7'").select("scope_id", "window_id", "version"))
query("sec.store_docs_delete", "SELECT scope_id, document_id FROM approved_docs WHERE scope_id <> 3")(lambda v: v.approved_docs.where("scope_id <> 3").select("scope_id", "document_id"))
query("sec.store_doc_load", "SELECT document_id, content_hash, size_bytes FROM approved_docs WHERE document_id = 'doc9'")(lambda v: where_equal(v.approved_docs, document_id="doc9").select("document_id", "content_hash", "size_bytes"))
query("sec.approved_docs", "SELECT scope_id, document_id, approved_at FROM approved_docs WHERE scope_id < 10")(lambda v: v.approved_docs.where("scope_id < 10").select("scope_id", "document_id", "approved_at"))
query("sec.revoke_document", "SELECT scope_id, document_id FROM approved_docs WHERE document_id NOT IN (SELECT document_id FROM citations)")(lambda v: without(v.approved_docs, v.citations, ["document_id"]).select("scope_id", "document_id"))
query("sec.list_versions", "SELECT window_id, count(*) AS n, max(version) AS newest FROM versions GROUP BY window_id")(lambda v: v.versions.groupBy("window_id").agg(F.count("*").alias("n"), F.max("version").alias("newest")))
query("sec.replay", "SELECT scope_id, window_id, max(version) + 1 AS version FROM versions GROUP BY 1, 2")(lambda v: v.versions.groupBy("scope_id", "window_id").agg((F.max("version") + 1).alias("version")))
query("sec.citation_for_url", "SELECT source_url, string_agg(observation_id, ',' ORDER BY observation_id) AS observations FROM citations GROUP BY source_url")(
    lambda v: v.citations.groupBy("source_url").agg(F.array_join(F.array_sort(F.collect_list("observation_id")), ",").alias("observations")))
query("nest.citation_register", "SELECT document_id, arg_max(observation_id, (last_verified_at, observation_id)) AS observation_id, max(last_verified_at) AS last_verified_at FROM citations GROUP BY document_id")(
    lambda v: latest(v.citations.select("document_id", "observation_id", "last_verified_at"), ["document_id"], ["last_verified_at", "observation_id"]))
query("txt.citation_md", "SELECT observation_id, '[' || document_id || coalesce('#' || section, '') || '](' || source_url || ')' AS link FROM citations")(
    lambda v: v.citations.select("observation_id", F.concat(F.lit("["), "document_id", F.coalesce(F.concat(F.lit("#"), "section"), F.lit("")), F.lit("]("), "source_url", F.lit(")")).alias("link")))
query("txt.citation_inline", "SELECT observation_id, citation_type || ':' || document_id || coalesce('#' || section, '') AS inline FROM citations")(
    lambda v: v.citations.select("observation_id", F.concat("citation_type", F.lit(":"), "document_id", F.coalesce(F.concat(F.lit("#"), "section"), F.lit(""))).alias("inline")))
