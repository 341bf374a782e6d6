"""Queries over lookup forms, proper nouns, configurations and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import documents, lookup as lk, plugins, text as tx
from cairn.operators import extraction as exr, graph as gr
from cairn.plans.text_queries import PLAIN, _in, _q
from cairn.registry import query
from cairn.sources import store
from cairn.streaming import limits

query("txt.normalise_lookup", f"SELECT doc_id, lower(regexp_replace(regexp_replace(trim(nfc_normalize(text)), {_q(lk.INVISIBLE)}, '', 'g'), {_q(lk.MARKS)}, '', 'g')) AS form FROM texts")(lambda v: v.texts.select("doc_id", lk.lookup_form(lk.nfc(F.col("text"))).alias("form")))


def _arabic():
    m = F.col("doc_id") % 4
    return F.when(m == 0, "والكتاب").when(m == 1, "بالبيت").when(m == 2, "كتاب").otherwise("word")


query("txt.arabic_clitics", "SELECT doc_id, doc_id % 4 IN (0, 2) AS matched FROM documents")(lambda v: v.documents.select("doc_id", lk.in_table(_arabic(), ["كتاب"], lk.ARABIC_CLITICS).alias("matched")))
query("txt.hebrew_clitics", "SELECT doc_id, doc_id % 2 = 0 AS matched FROM documents")(lambda v: v.documents.select("doc_id", lk.in_table(F.when(F.col("doc_id") % 2 == 0, "ובבית").otherwise("ספר"), ["בית"], lk.HEBREW_CLITICS).alias("matched")))
query("txt.cjk_nouns", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\x{30A1}-\x{30FF}]{2,}'), '|') AS terms FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(F.transform(F.filter(lk.cjk_nouns(F.col("text")), lambda n: n["kind"] == "term"), lambda n: n["content"]), "|").alias("terms")))
_COUNT = lambda tag: rf"len([t for t in regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') if t IN {_in(lk.COMMON_WORDS[tag])}])"
query("txt.detect_language", "SELECT doc_id, CASE WHEN greatest(de, en, es, fr) < 3 THEN NULL WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS language FROM (SELECT doc_id, " + ", ".join(f"{_COUNT(t)} AS {t}" for t in lk.COMMON_WORDS) + " FROM documents)")(
    lambda v: v.documents.select("doc_id", lk.language_by_words(tx.tokens(F.col("text"))).alias("language")))
query("txt.recap_entities", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({PLAIN}, '\b[A-Z]{{2,}}[0-9]*\b|\b[A-Z][a-z]+[A-Z][A-Za-z]*\b'))), '|') AS entities FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{2,}[0-9]*\b|\b[A-Z][a-z]+[A-Z][A-Za-z]*\b"), 0))), "|").alias("entities")))
query("txt.sim_obs_type", """SELECT doc_id, CASE WHEN starts_with(lower(text), 'todo') OR contains(lower(text), 'action item') THEN 'task' WHEN starts_with(lower(text), 'what ') OR starts_with(lower(text), 'how ') OR contains(text, '?') THEN 'question'
    WHEN regexp_matches(lower(text), 'decided|approved|agreed') THEN 'decision' WHEN contains(lower(text), 'reminder') THEN 'task' WHEN regexp_matches(lower(text), 'resolved|complete|restored') THEN 'fact'
    WHEN regexp_matches(lower(text), '^(?:lol|ok|nice|thanks|great|looks|welcome|numbers)') THEN 'noise' ELSE 'fact' END AS kind FROM texts""")(
    lambda v: v.texts.select("doc_id", exr.turn_kind(F.col("text")).alias("kind")))
query("sink.index_embedding")(lambda v: plugins.embed(v.documents.select("doc_id", "text"), "text", plugins.hashing_embedder).select("doc_id", "embedding"))
query("nest.bundle_parse", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'well' WHEN 1 THEN 'cut' END AS recap, doc_id % 3 = 1 AS salvaged FROM documents""")(
    lambda v: v.documents.select("doc_id", store.parse_bundle(F.when(F.col("doc_id") % 3 == 0, 'x {"recap": "well"} y').when(F.col("doc_id") % 3 == 1, '{"recap": "cut').otherwise("none")).alias("b")).select("doc_id", F.col("b.bundle.recap").alias("recap"), "b.salvaged"))
query("scan.memory_blob", "SELECT id, CASE WHEN metadata LIKE '%: true%' THEN true WHEN metadata LIKE '%: false%' THEN false END AS contradicted FROM memory")(lambda v: v.memory.select("id", store.blob(F.col("metadata"), "contradicted boolean")["contradicted"].alias("contradicted")))
query("scan.connector_instances", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")(lambda v: v.events.select("event_id", store.blob(F.col("props"), "k bigint")["k"].alias("k")))
query("flt.adapter_order", "SELECT DISTINCT tier, CASE tier WHEN 0 THEN 'cpu' WHEN 1 THEN 'gpu>cpu' ELSE 'npu>gpu>cpu' END AS adapters FROM devices")(
    lambda v: v.devices.select("tier", F.array_join(F.filter(F.array(F.lit("npu"), F.lit("gpu"), F.lit("cpu")), lambda a: (F.col("tier") >= 2) | ((F.col("tier") == 1) & (a != "npu")) | (a == "cpu")), ">").alias("adapters")).distinct())
query("sec.adapter_states", "SELECT tier, count(*) FILTER (WHERE online) AS available FROM devices GROUP BY tier")(lambda v: v.devices.groupBy("tier").agg(F.count_if("online").alias("available")))
query("lc.tenant_no_passive_decay", "SELECT id, observation_type <> 'purchase' AS may_decay FROM memory")(lambda v: v.memory.select("id", (F.col("observation_type") != "purchase").alias("may_decay")))
query("sec.mem_add_observation", "SELECT id, state FROM memory UNION ALL SELECT 'obs-' || CAST(id AS VARCHAR), 'candidate' FROM observations")(
    lambda v: v.memory.select("id", "state").union(v.observations.select(F.concat(F.lit("obs-"), F.col("id").cast("string")), F.lit("candidate"))))
query("sec.admit_document", "SELECT document_id FROM approved_docs UNION SELECT document_id FROM citations")(lambda v: v.approved_docs.select("document_id").union(v.citations.select("document_id")).distinct())
query("sec.metrics_snapshot", "SELECT 'evidence' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'nodes', count(*) FROM nodes")(
    lambda v: v.documents.agg(F.lit("evidence").alias("metric"), F.count("*").alias("value")).union(v.events.agg(F.lit("events"), F.count("*"))).union(v.nodes.agg(F.lit("nodes"), F.count("*"))))
query("agg.obs_eval")(lambda v: obs_eval(v))
query("sec.tokens_for_host")(lambda v: limits.replay(v.requests, "route", "moment", "id", limits.token_bucket(5, 1 / 900)))
query("sec.rate_allow")(lambda v: limits.replay(v.requests, "tenant_id", "moment", "id", limits.token_bucket(2, 1 / 1800)))
query("st.sync_state", "SELECT document_id, max(occurred_at) AS cursor, count(*) = 1 AS initial FROM source_events GROUP BY document_id")(lambda v: v.source_events.groupBy("document_id").agg(F.max("occurred_at").alias("cursor"), (F.count("*") == 1).alias("initial")))
query("st.batcher", "SELECT id, CAST(floor((row_number() OVER (PARTITION BY scope_id ORDER BY id) - 1) / 8.0) AS BIGINT) AS batch FROM ring")(
    lambda v: v.ring.select("id", F.floor((F.row_number().over(tx_window()) - 1) / 8.0).alias("batch")))
query("graph.got_expand", """WITH RECURSIVE kids AS (SELECT src, dst, w FROM (SELECT src, dst, max(CASE relation WHEN 'part_of' THEN 0.9 WHEN 'derived_from' THEN 0.7 ELSE 0.8 END) AS w FROM edges GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 2),
    grown(root, node, depth, score) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM nodes WHERE id IN ('c50', 'c99', 'c20') UNION ALL SELECT g.root, k.dst, g.depth + 1, g.score * k.w FROM grown g JOIN kids k ON k.src = g.node WHERE g.depth < 4)
    SELECT root, node, depth, round(score, 6) AS score FROM (SELECT root, node, min(depth) AS depth, arg_min(score, (depth, -score)) AS score FROM grown GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, score DESC, node) <= 6""")(
    lambda v: gr.expand_thoughts(v.nodes.where("id IN ('c50', 'c99', 'c20')").select("id"), v.edges.select("src", "dst", F.when(F.col("relation") == "part_of", 0.9).when(F.col("relation") == "derived_from", 0.7).otherwise(0.8).alias("weight")), depth=4, branch=2, most=6).select("root", "node", "depth", F.round("score", 6).alias("score")))
query("nest.json_pretty", """SELECT event_id, '{' || chr(10) || '  "k": ' || regexp_extract(props, '[0-9]+') || chr(10) || '}' AS pretty FROM events""")(lambda v: v.events.select("event_id", documents.pretty_json(F.col("props")).alias("pretty")))
query("scan.fetched_content", r"""SELECT page_id, 'text/html' AS mime, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS body, url AS source_url FROM pages""")(
    lambda v: v.pages.select("page_id", documents.fetched(F.col("html"), F.col("url")).alias("f")).select("page_id", "f.*"))


def tx_window():
    from pyspark.sql import Window

    return Window.partitionBy("scope_id").orderBy("id")


def obs_eval(v):
    """Extraction against what a turn as a whole is expected to be, by the end of its last sentence."""
    made = exr.observations(v.texts).select(F.col("doc_id").alias("case_id"), "kind", "content")
    last = F.element_at(F.filter(F.split("text", "[.!?\\n]"), lambda s: F.trim(s) != ""), -1)
    want = v.texts.where(F.trim("text") != "").select(F.col("doc_id").alias("case_id"), exr.turn_kind(F.col("text")).alias("kind"), F.upper(F.trim(last)).alias("content")).where("content is not null and kind <> 'noise'")
    return exr.scores(plugins.evaluate(made, want))
