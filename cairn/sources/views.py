"""The engine's data model over the benchmark tables.

Each view is one SELECT that Spark and other engines read alike. Two marks stand for what
they write differently: ``EPOCH(x)`` is a time as whole seconds since 1970, ``DIV(a, b)`` is
integer division. Times are such seconds (BIGINT) throughout the data model.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "evidence": """SELECT doc_id AS evidence_id, source AS scope_id, text AS body, md5(text) AS content_hash, source AS source_ref, lang AS language_tag,
        1704067200 + 60 * doc_id AS created_at, CAST(CASE WHEN doc_id % 20 = 0 THEN 3 WHEN doc_id % 20 <= 6 THEN 2 WHEN doc_id % 20 <= 16 THEN 1 ELSE 0 END AS INT) AS importance,
        octet_length(CAST(text AS BLOBTYPE)) AS size_bytes FROM documents""",
    "evidence_vec": """SELECT v.vec_id AS evidence_id, d.source AS scope_id, v.embedding, concat('m', CAST(v.label % 2 AS STRINGTYPE)) AS model_tag, md5(d.text) AS content_hash
        FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id""",
    "xref": """SELECT event_id AS evidence_id, CAST(user_id % 20 AS STRINGTYPE) AS scope_id, 'user' AS ref_key, CAST(user_id AS STRINGTYPE) AS ref_value, EPOCH(ts) AS created_at FROM events
        UNION ALL SELECT event_id, CAST(user_id % 20 AS STRINGTYPE), 'k', regexp_extract(props, '[0-9]+', 0), EPOCH(ts) FROM events WHERE event_type = 'purchase'""",
    "overrides": "SELECT doc_id AS evidence_id, quality + 2 * toxic AS new_importance, 1706745600 AS overridden_at FROM labels",
    "ring": """SELECT event_id AS id, CAST(user_id AS STRINGTYPE) AS scope_id, 64 + event_id % 512 AS payload_size, event_id % 3 AS priority, EPOCH(ts) AS created_at, EPOCH(ts) + event_id % 7200 AS last_accessed_at
        FROM events WHERE event_type = 'error'""",
    "forgotten": "SELECT concat('src', CAST(n_nationkey AS STRINGTYPE)) AS scope_id, 1704067200 + 3600 * n_nationkey AS forgotten_at FROM nation WHERE n_nationkey % 7 = 3",
    "epoch_tombstones": "SELECT concat('src', CAST(n_nationkey AS STRINGTYPE)) AS scope_id, n_regionkey AS epoch_id, 1704067200 + 60 * n_nationkey AS forgotten_at FROM nation",
    "memory": """SELECT concat(CAST(user_id AS STRINGTYPE), '-', event_type) AS id, CAST(user_id AS STRINGTYPE) AS scope_id, event_type AS observation_type,
        CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'important' WHEN 'error' THEN 'noise' ELSE 'useful' END AS sensitivity,
        min(EPOCH(ts)) AS created_at, max(EPOCH(ts)) AS last_accessed_at, count(*) AS retrieval_count, count(DISTINCT DIV(EPOCH(ts), 86400)) AS corroboration_count,
        CAST(CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS pin_count,
        CASE user_id % 7 WHEN 0 THEN 'candidate' WHEN 1 THEN 'reinforced' WHEN 2 THEN 'consolidated' WHEN 3 THEN 'canonical' WHEN 4 THEN 'superseded' WHEN 5 THEN 'archived' ELSE 'deleted' END AS state,
        CASE WHEN user_id % 7 = 4 THEN concat(CAST(user_id + 1 AS STRINGTYPE), '-', event_type) END AS superseded_by,
        CASE WHEN user_id % 13 = 0 THEN '{"contradicted": true}' WHEN user_id % 13 = 1 THEN '{"contradicted": false, "position": {"x": 1.5, "y": 2}}' ELSE '{}' END AS metadata,
        CASE WHEN user_id % 7 = 2 THEN max(EPOCH(ts)) - 86400 * (user_id % 20) END AS consolidated_at,
        CASE user_id % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'en-US' WHEN 2 THEN 'ar' ELSE 'th' END AS language_tag
        FROM events GROUP BY user_id, event_type""",
    "memory_sources": "SELECT concat(CAST(user_id AS STRINGTYPE), '-', event_type) AS id, CAST(event_id AS STRINGTYPE) AS source, EPOCH(ts) AS moment FROM events",
    "observations": """SELECT CAST(conv_id AS STRINGTYPE) AS scope_id, conv_id * 100 + turn AS id, 1704067200 + conv_id * 86400 + turn * 700 + CASE WHEN turn % 3 = 2 THEN 1100 ELSE 0 END AS occurred_at,
        CASE WHEN (conv_id + turn) % 9 = 4 THEN text || ' /end session' ELSE text END AS body FROM conversations""",
    "clicks": "SELECT event_id AS id, CAST(user_id AS STRINGTYPE) AS scope_id, EPOCH(ts) AS occurred_at, event_type AS body FROM events",
    "nodes": """SELECT concat('r', CAST(r_regionkey AS STRINGTYPE)) AS id, r_name AS label, concat('region ', r_name) AS definition, 's0' AS scope_id, 'canonical' AS state, r_regionkey AS created_at FROM region
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRINGTYPE)), n_name, concat('nation ', n_name), concat('s', CAST(n_regionkey AS STRINGTYPE)), CASE n_nationkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'superseded' ELSE 'canonical' END, 10 + n_nationkey FROM nation
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRINGTYPE)), c_name, c_mktsegment, concat('s', CAST(c_nationkey % 5 AS STRINGTYPE)), CASE c_custkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'superseded' WHEN 2 THEN 'contradicted' ELSE 'canonical' END, 100 + c_custkey FROM customer
        UNION ALL SELECT concat('u', CAST(s_suppkey AS STRINGTYPE)), s_name, 'supplier', concat('s', CAST(s_nationkey % 5 AS STRINGTYPE)), 'canonical', 100000000 + s_suppkey FROM supplier""",
    "edges": """SELECT concat('en', CAST(n_nationkey AS STRINGTYPE)) AS id, concat('n', CAST(n_nationkey AS STRINGTYPE)) AS src, concat('r', CAST(n_regionkey AS STRINGTYPE)) AS dst, 'part_of' AS relation, concat('s', CAST(n_regionkey AS STRINGTYPE)) AS scope_id FROM nation
        UNION ALL SELECT concat('ec', CAST(c_custkey AS STRINGTYPE)), concat('c', CAST(c_custkey AS STRINGTYPE)), concat('n', CAST(c_nationkey AS STRINGTYPE)), 'part_of', concat('s', CAST(c_nationkey % 5 AS STRINGTYPE)) FROM customer
        UNION ALL SELECT concat('eu', CAST(s_suppkey AS STRINGTYPE)), concat('u', CAST(s_suppkey AS STRINGTYPE)), concat('n', CAST(s_nationkey AS STRINGTYPE)), 'assigned_to', concat('s', CAST(s_nationkey % 5 AS STRINGTYPE)) FROM supplier
        UNION ALL SELECT concat('ed', CAST(c_custkey AS STRINGTYPE)), concat('c', CAST(c_custkey AS STRINGTYPE)), concat('c', CAST(c_custkey - 1 - c_custkey % 7 AS STRINGTYPE)), 'derived_from', concat('s', CAST(c_nationkey % 5 AS STRINGTYPE)) FROM customer WHERE c_custkey - 1 - c_custkey % 7 >= 1""",
    "claims": """SELECT concat('a', CAST(n_nationkey AS STRINGTYPE)) AS id, concat('s', CAST(n_regionkey AS STRINGTYPE)) AS scope_id, concat(n_name, ' is open.') AS label, CASE WHEN n_nationkey % 6 = 5 THEN 'candidate' ELSE 'canonical' END AS state FROM nation
        UNION ALL SELECT concat('b', CAST(n_nationkey AS STRINGTYPE)), concat('s', CAST(n_regionkey AS STRINGTYPE)), CASE n_nationkey % 4 WHEN 0 THEN concat(n_name, ' isn''t open') WHEN 1 THEN concat(n_name, ' is not open!') WHEN 2 THEN concat(n_name, ' is no longer open') ELSE concat(n_name, ' is never not open') END, 'canonical' FROM nation""",
    "tuples": """SELECT 'scope' AS object_type, concat('region', CAST(r_regionkey AS STRINGTYPE)) AS object_id, 'owner' AS relation, 'group' AS subject_type, concat('nation', CAST(r_regionkey AS STRINGTYPE)) AS subject_id, 'member' AS subject_relation FROM region
        UNION ALL SELECT 'scope', concat('region', CAST(n_regionkey AS STRINGTYPE)), CASE n_nationkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'owner' END, 'group', concat('nation', CAST(n_nationkey AS STRINGTYPE)), 'member' FROM nation
        UNION ALL SELECT 'group', concat('nation', CAST(n_nationkey AS STRINGTYPE)), 'member', 'group', concat('nation', CAST((n_nationkey + 5) % 25 AS STRINGTYPE)), 'member' FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'group', concat('nation', CAST(c_nationkey AS STRINGTYPE)), 'member', 'user', concat('user', CAST(c_custkey AS STRINGTYPE)), CAST(NULL AS STRINGTYPE) FROM customer""",
    "op_log": """SELECT user_id % 4 AS replica, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'supersede' ELSE 'add' END AS kind,
        regexp_extract(props, '[0-9]+', 0) AS value, concat('t', CAST(event_id AS STRINGTYPE)) AS tag, CASE event_type WHEN 'error' THEN concat('t', CAST(event_id - 1 - event_id % 3 AS STRINGTYPE)) END AS observed_tag,
        CASE event_type WHEN 'signup' THEN concat('v', CAST(event_id % 50 AS STRINGTYPE)) END AS successor, EPOCH(ts) AS created_at FROM events""",
    "source_events": """SELECT o_custkey AS document_id, o_orderkey AS event_id, EPOCH(CAST(o_orderdate AS TIMESTAMP)) AS occurred_at, CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'updated' ELSE 'created' END AS kind FROM orders""",
    "audit": """SELECT event_id AS sequence, event_id AS id, concat('user', CAST(user_id AS STRINGTYPE)) AS actor, event_type AS action, CAST(user_id % 20 AS STRINGTYPE) AS scope_id, CAST(user_id % 5 AS STRINGTYPE) AS tenant_id, EPOCH(ts) AS moment FROM events""",
    "requests": """SELECT event_id AS id, CASE event_type WHEN 'click' THEN '/api/v1/query' WHEN 'view' THEN '/api/v1/evidence/17' WHEN 'purchase' THEN '/api/v1/synthesis/trigger' WHEN 'signup' THEN '/api/v1/queryable' ELSE '/healthz' END AS route,
        CAST(user_id AS STRINGTYPE) AS tenant_id, CAST(value AS DOUBLE) / 100 AS seconds, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 429 ELSE 200 END AS status, EPOCH(ts) AS moment FROM events""",
    "concepts": """SELECT concat('p', CAST(p_partkey AS STRINGTYPE)) AS id, p_brand AS scope_id, p_name AS label, p_type AS definition, CASE p_size % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'useful' WHEN 2 THEN 'important' ELSE 'critical' END AS sensitivity,
        CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('doc', CAST(p_partkey AS STRINGTYPE)) END AS provenance, 1706745600 - 86400 * (p_partkey % 400) AS approved_at, CASE WHEN p_partkey % 5 = 0 THEN 1706745600 - 43200 + 86400 * (p_partkey % 3) END AS expires_at,
        CAST(p_size AS DOUBLE) / 50 AS confidence, p_partkey % 6 AS corroboration_count, p_partkey AS position FROM part""",
    "controls": """SELECT concat('p', CAST(p_partkey AS STRINGTYPE)) AS concept_id, CASE WHEN p_partkey % 3 = 0 THEN 'profile1' ELSE 'profile2' END AS profile_id, p_brand AS scope_id, 1706745600 - 3600 * (p_partkey % 60) AS granted_at,
        CASE WHEN p_partkey % 4 = 0 THEN 86400 * (1 + p_partkey % 3) END AS bound_seconds FROM part WHERE p_partkey % 9 <> 4""",
    "proposals": """SELECT concat('q', CAST(p_partkey AS STRINGTYPE)) AS id, CASE p_partkey % 4 WHEN 0 THEN 'observation' WHEN 1 THEN 'concept' WHEN 2 THEN 'relation' ELSE 'summary' END AS kind, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_brand END AS scope_id,
        CAST(p_size AS DOUBLE) / 45 AS confidence, p_partkey % 5 AS corroboration_count, CASE p_size % 4 WHEN 0 THEN 'noise' WHEN 1 THEN 'useful' WHEN 2 THEN 'important' ELSE 'critical' END AS sensitivity,
        CASE p_partkey % 5 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'under_review' ELSE 'submitted' END AS status, 1706745600 - 3600 * (p_partkey % 300) AS submitted_at, 86400 * 7 AS ttl_seconds,
        CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS content, concat('agent', CAST(p_partkey % 7 AS STRINGTYPE)) AS agent_id FROM part""",
    "devices": """SELECT concat('d', CAST(s_suppkey AS STRINGTYPE)) AS id, s_nationkey AS scope_id, s_suppkey % 3 AS tier, CAST(s_suppkey * 37 % 101 AS INT) AS battery, s_suppkey % 5 <> 0 AS online, s_suppkey % 7 = 0 AS stepped_down, 1706745600 - s_suppkey * 13 % 600 AS heartbeat_at FROM supplier""",
    "windows": """SELECT concat('w', CAST(o_orderkey AS STRINGTYPE)) AS id, concat('c', CAST(o_custkey % 40 AS STRINGTYPE)) AS scope_id, EPOCH(CAST(o_orderdate AS TIMESTAMP)) AS window_start, EPOCH(CAST(o_orderdate AS TIMESTAMP)) + 86400 * (1 + o_orderkey % 5) AS window_end,
        CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'complete' ELSE 'failed' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'channel' WHEN 1 THEN 'domain' ELSE 'tenant' END AS tier FROM orders""",
    "versions": """SELECT concat('c', CAST(l_orderkey % 40 AS STRINGTYPE)) AS scope_id, concat('w', CAST(l_orderkey AS STRINGTYPE)) AS window_id, l_linenumber AS version, 1704067200 + 3600 * l_linenumber AS created_at, concat('recap ', CAST(l_partkey AS STRINGTYPE)) AS recap FROM lineitem""",
    "citations": """SELECT concat('o', CAST(page_id AS STRINGTYPE)) AS observation_id, url AS source_url, CASE page_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'message' ELSE 'web' END AS citation_type, concat('doc', CAST(page_id % 40 AS STRINGTYPE)) AS document_id,
        CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('s', CAST(page_id % 9 AS STRINGTYPE)) END AS section, 1706745600 - 86400 * (page_id % 60) AS last_verified_at FROM pages""",
    "approved_docs": """SELECT s_nationkey AS scope_id, concat('doc', CAST(s_suppkey AS STRINGTYPE)) AS document_id, md5(CAST(s_suppkey % 40 AS STRINGTYPE)) AS content_hash, 100 + s_suppkey AS size_bytes, 1704067200 + s_suppkey AS approved_at FROM supplier""",
    "tasks": """SELECT o_orderkey AS id, concat('c', CAST(o_custkey % 40 AS STRINGTYPE)) AS scope_id, concat(' Ship  ORDER ', CAST(o_orderkey % 50 AS STRINGTYPE), ' ') AS text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('user', CAST(o_custkey % 9 AS STRINGTYPE)) END AS assignee,
        CASE o_orderkey % 9 WHEN 0 THEN 'task' WHEN 1 THEN 'question' WHEN 2 THEN 'workstream' WHEN 3 THEN 'dependency' WHEN 4 THEN 'risk' WHEN 5 THEN 'procedure' WHEN 6 THEN 'policy' WHEN 7 THEN 'taxonomy' ELSE 'fact' END AS kind,
        CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 9 END AS superseded_by, CASE WHEN o_orderstatus = 'F' THEN 1706745600 - 86400 * (o_orderkey % 60) END AS completed_at, 1704067200 + o_orderkey AS created_at FROM orders""",
    "turns": """SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 't0' WHEN 1 THEN 't1' ELSE 't2' END AS tenant_id, CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'ja' WHEN 3 THEN 'th' ELSE 'ar' END AS language, event_type AS scenario_id, event_id % 7 <> 0 AS passed FROM events""",
    "cultural": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Dr. Ada Lovelace' WHEN 1 THEN '山田太郎様' WHEN 2 THEN 'Mr John Q Public' WHEN 3 THEN '王 小明先生' WHEN 4 THEN 'Cher' WHEN 5 THEN 'Ông Minh Duc' WHEN 6 THEN 'คุณสมชาย' ELSE 'Prof. X' END AS name,
        CASE doc_id % 8 WHEN 1 THEN 'ja' WHEN 3 THEN 'zh' WHEN 5 THEN 'vi' WHEN 6 THEN 'th' ELSE 'en' END AS language_tag,
        CASE doc_id % 8 WHEN 0 THEN '$1,299.00' WHEN 1 THEN '€1.234,56' WHEN 2 THEN '20,5 EUR' WHEN 3 THEN '¥12,000' WHEN 4 THEN '£3.5m' WHEN 5 THEN '1 000 USD' WHEN 6 THEN 'twelve' ELSE '7€' END AS money,
        CASE doc_id % 6 WHEN 0 THEN '〒100-0001 Tokyo' WHEN 1 THEN 'Springfield IL 62704' WHEN 2 THEN 'London SW1A 1AA' WHEN 3 THEN '10115 Berlin, Germany' WHEN 4 THEN 'nowhere' ELSE 'Main St 12' END AS address,
        CASE doc_id % 8 WHEN 0 THEN '令和6年2月1日' WHEN 1 THEN 'พ.ศ. 2567-02-01' WHEN 2 THEN '农历2024年1月15日' WHEN 3 THEN '9-1-1445 AH' WHEN 4 THEN '2024-02-01' WHEN 5 THEN '昭和64年1月7日' WHEN 6 THEN 'พ.ศ. 2500' ELSE 'next week' END AS dated FROM documents""",
    "labels_bio": """SELECT c_custkey AS doc_id, n AS place, CASE (c_custkey + n) % 5 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'O' WHEN 3 THEN 'B-ORG' ELSE 'I-ORG' END AS label, concat('w', CAST(n AS STRINGTYPE)) AS word FROM customer CROSS JOIN (SELECT n_nationkey AS n FROM nation) AS k""",
    "texts": """SELECT doc_id, text || ' ' || CASE doc_id % 24
        WHEN 0 THEN 'Wire to DE89370400440532013000 and GB82WEST12345698765432 today.' WHEN 1 THEN 'ISIN US0378331005 rose; BIC DEUTDEFF500 failed. LEI 5493001KJTIIGC8Y1R12'
        WHEN 2 THEN 'Buy $AAPL and $TSLA before Friday? Not yet.' WHEN 3 THEN 'Diagnosis E11.9 with NDC 0002-8215-01, patent US10123456B2 applies.'
        WHEN 4 THEN 'See case No. 22-cv-01234 and SKU-ABC-12345; S/N: AB12CD34.' WHEN 5 THEN 'ASIN B08N5WRWNW, PO-2024-001, INV-77120 due.'
        WHEN 6 THEN 'Call +1 415 555 2671 from 192.168.0.1 or 300.1.1.1 or 2001:0DB8:85a3:0000:0000:8a2e:0370:7334 now.' WHEN 7 THEN 'Paid $1,299.00 and 5 GB for 10 km, total 30%.'
        WHEN 8 THEN 'The deadline is not approved by @alice_1. Please review https://example.com/a?b=1).' WHEN 9 THEN 'Budget was approved; Bob Smith will ship the release on Monday.'
        WHEN 10 THEN 'no longer a blocker, the launch was cancelled' WHEN 11 THEN 'ok' WHEN 12 THEN 'Thank you!' WHEN 13 THEN '' WHEN 14 THEN '   ' WHEN 15 THEN 'Mail bob@example.com, eve@test.org!'
        WHEN 16 THEN '東京で会議。プロジェクトの予算は承認されました' WHEN 17 THEN 'สวัสดี meeting 会議 tomorrow' WHEN 18 THEN 'What is the policy? Who owns the milestone!' WHEN 19 THEN 'catch me up on last week' WHEN 20 THEN 'assigned to Carol, blocked by abc-123 and X-99'
        WHEN 21 THEN 'Ticket # 42 costs €20.50 or 1.234,56 EUR' WHEN 22 THEN 'the outage incident: never again, Q3 2024 on March 5' ELSE '' END AS text, lang AS language_tag FROM documents""",
}

_CALL = re.compile(r"\b(EPOCH|DIV)\(")


def _calls(sql: str, forms: dict[str, str]) -> str:
    """Replace the marks, arguments and all, innermost last."""
    while m := _CALL.search(sql):
        depth, moment, cut = 1, m.end(), [m.end()]
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[moment], 0)
            if sql[moment] == "," and depth == 1:
                cut.append(moment + 1)
            moment += 1
        args = [sql[a:b].strip() for a, b in zip(cut, [*(c - 1 for c in cut[1:]), moment - 1], strict=True)]
        sql = sql[: m.start()] + forms[m[1]].format(*args) + sql[moment:]
    return sql


def _dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"\s+", " ", sql)
    if spark:
        sql = _calls(sql, {"EPOCH": "unix_timestamp(CAST({0} AS TIMESTAMP))", "DIV": "({0} div {1})"})
        return sql.replace("octet_length(CAST(text AS BLOBTYPE))", "CAST(octet_length(text) AS BIGINT)").replace("STRINGTYPE", "STRING").replace("isn''t", "isn\\'t")
    sql = _calls(sql, {"EPOCH": "CAST(floor(epoch({0})) AS BIGINT)", "DIV": "({0} // {1})"})
    return sql.replace("octet_length(CAST(text AS BLOBTYPE))", "octet_length(encode(text))").replace("STRINGTYPE", "VARCHAR")


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|,|IN \(SELECT \w+ FROM)\s*{v}\b", sql, re.I)]


def definitions(sql: str) -> list[tuple[str, str]]:
    """The views that a query names, as SQL of the other engine."""
    return [(v, _dialect(VIEWS[v], False)) for v in _needs(sql)]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name not in VIEWS:
        raise AttributeError(name)
    sql = _dialect(VIEWS[name], True)
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
