"""Queries whose results depend on the order of events; SQL has no form for most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.registry import query
from cairn.streaming import connectors, limits

query("st.quota")(lambda v: limits.replay(v.requests, "tenant_id", "moment", "id", limits.quota(20, 86_400)))
query("st.token_bucket")(lambda v: limits.replay(v.requests, "tenant_id", "moment", "id", limits.token_bucket(3, 1 / 3600)))
query("st.provider_limiter")(lambda v: limits.replay(v.requests, "route", "moment", "id", limits.token_bucket(10, 1 / 600)))
query("st.rate_window")(lambda v: limits.replay(v.requests, "tenant_id", "moment", "id", limits.quota(2, 3600)))
query("st.cooldown")(lambda v: limits.replay(v.requests, "tenant_id", "moment", "id", limits.cooldown(300)))
query("st.epoch_rotation")(lambda v: limits.replay(v.ring, "scope_id", "created_at", "id", limits.rotation(7 * 86_400, 2048), "payload_size"))
query("st.audit_consumer", "SELECT DISTINCT id, actor, action FROM audit")(lambda v: v.audit.union(v.audit.where("id % 2 = 0")).dropDuplicates(["id"]).select("id", "actor", "action"))
query("scan.webhook_parse", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'vanished' END AS kind, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_kind' ELSE 'malformed' END AS quarantine FROM documents""")(
    lambda v: connectors.parse_webhooks(v.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"kind": "created", "document_id": "'), F.col("doc_id").cast("string"), F.lit('", "occurred_at": 5}')))
    .when(F.col("doc_id") % 4 == 1, F.lit('{"kind": "vanished", "document_id": "x"}')).when(F.col("doc_id") % 4 == 2, F.lit('{"document_id": "x"}')).otherwise(F.lit("no json")).alias("body"))).select("doc_id", "kind", "quarantine"))
