"""Queries of checks and of decisions by fixed rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from cairn.functions import entities as ent, text as tx
from cairn.operators import extraction as exr, governance as gov, graph as gr, judging as jd, postings as ix
from cairn.plans.cultural_queries import _DOMAIN, _GROUPS, _PAIRS, expanded
from cairn.plans.durable import Scratch
from cairn.plans.graph_queries import _PARTS, _parts
from cairn.plans.governance_queries import _GIVES
from cairn.plans.indexes import index_of, new_store
from cairn.plans.search_queries import SEARCHED
from cairn.plans.text_queries import QCLASS, _EACH
from cairn.registry import query
from cairn.sources.versions import vacuum_report

# ---- verification

_TURNS = f"(SELECT doc_id AS turn_id, source AS scope_id, doc_id % 3 AS importance, ([t for t in {SEARCHED['word']} if length(t) >= 4])[1] AS term FROM documents WHERE doc_id % 100 = 0)"
_HITS = f"(SELECT t.turn_id, d.doc_id AS evidence_id FROM {_TURNS} t JOIN (SELECT doc_id, source, {SEARCHED['word']} AS w FROM documents WHERE source NOT IN (SELECT scope_id FROM forgotten)) d ON d.source = t.scope_id AND list_contains(d.w, t.term))"


def retrieval_checks(v) -> DataFrame:
    """Every hundredth document is a turn whose first long word should find it in its own scope; forgotten scopes find nothing."""
    turns = v.documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("turn_id"), F.col("source").alias("scope_id"), (F.col("doc_id") % 3).alias("importance"), F.col("doc_id").alias("expected_id"), F.get(tx.salient_terms(F.col("text")), 0).alias("term"))
    kept = v.documents.join(v.forgotten.select(F.col("scope_id").alias("source")), "source", "left_anti").select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("scope_id"))
    found = index_of(v.documents, "doc_id", "text").postings.where("lane = 'word'").select("term", F.col("doc").alias("evidence_id"), F.size("positions").alias("score"))
    hits = found.join(turns.where("term IS NOT NULL").select("turn_id", "scope_id", "term"), "term").join(kept, ["evidence_id", "scope_id"]).select("turn_id", "evidence_id", "score")
    return jd.verify_retrieval(turns, hits)


query("sec.sim_verify", f"""WITH h AS {_HITS}, s AS (SELECT t.turn_id, t.importance, count(h.evidence_id) AS n, coalesce(bool_or(h.evidence_id = t.turn_id), false) AS found FROM {_TURNS} t LEFT JOIN h USING (turn_id) GROUP BY 1, 2)
    SELECT turn_id, 'retrieval_nonempty' AS assertion, n > 0 AS passed FROM s WHERE importance > 0 UNION ALL SELECT turn_id, 'retrieval_expected_id_found', found FROM s UNION ALL SELECT turn_id, 'retrieval_scores_positive', true FROM s""")(retrieval_checks)


def forget_checks(v) -> DataFrame:
    """Forgotten scopes are written out of the files and of an index; then all scopes are looked into."""
    index = new_store(v.spark, "forget-index")
    ix.write(index, v.documents, "doc_id", "text", lanes=("word",))
    of = v.documents.select(F.col("doc_id").alias("doc"), F.col("source").alias("scope_id"))
    ix.remove(index, of.join(v.forgotten.select("scope_id"), "scope_id", "left_semi").select("doc"))
    index.vacuum()  # the version before still holds them
    store = new_store(v.spark, "forget")
    store.commit({"evidence": v.evidence.select("evidence_id", "scope_id", "body")})
    vacuum_report(store, "evidence", "scope_id", F.octet_length("body"), v.forgotten)
    hits = ix.Index(index).search("the OR la OR der").join(of, "doc").select("scope_id")
    return jd.verify_forget(v.evidence.select("scope_id"), store.read("evidence").select("scope_id"), hits, v.forgotten)


_ANY = f"len([t for t in {SEARCHED['word']} if t IN ('the', 'la', 'der')]) > 0"
query("sec.sim_forget", f"""WITH s AS (SELECT source AS scope_id, source IN (SELECT scope_id FROM forgotten) AS gone, bool_or({_ANY}) AS heard FROM documents GROUP BY 1, 2)
    SELECT scope_id, 'forget_body_unreadable' AS assertion, gone AS passed FROM s UNION ALL SELECT scope_id, 'forget_fts_empty', gone OR NOT coalesce(heard, false) FROM s UNION ALL SELECT scope_id, 'forget_tombstone_recorded', gone FROM s""")(forget_checks)

_HALF = 1_705_276_800  # half way through the month of the events
query("sec.perf_gate", f"""SELECT metric, round(value, 6) AS value, round(baseline, 6) AS baseline, CASE WHEN metric LIKE 'seconds%' THEN value > baseline * 1.05 ELSE value < baseline * 0.95 END AS regressed FROM (
    SELECT 'seconds ' || route AS metric, avg(seconds) FILTER (WHERE moment >= {_HALF}) AS value, avg(seconds) FILTER (WHERE moment < {_HALF}) AS baseline FROM requests GROUP BY route
    UNION ALL SELECT 'served ' || route, count(*) FILTER (WHERE moment >= {_HALF} AND status = 200), count(*) FILTER (WHERE moment < {_HALF} AND status = 200) FROM requests GROUP BY route)""")(lambda v: gate(v))


def gate(v) -> DataFrame:
    """The second half of the requests against the first: seconds should be few, requests served many."""
    def side(rows, name):
        own = rows.groupBy("route").agg(F.avg("seconds").alias("s"), F.count_if(F.col("status") == 200).cast("double").alias("n"))
        return own.select(F.explode(F.array(F.struct(F.concat(F.lit("seconds "), "route").alias("metric"), F.col("s").alias(name), F.lit("lower_is_better").alias("direction")), F.struct(F.concat(F.lit("served "), "route").alias("metric"), F.col("n").alias(name), F.lit("higher_is_better").alias("direction")))).alias("m")).select("m.*")

    now, then = side(v.requests.where(F.col("moment") >= _HALF), "value").drop("direction"), side(v.requests.where(F.col("moment") < _HALF), "baseline")
    return jd.regressions(now, then, 0.05).select("metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "regressed")


# ---- entities

_SAID = "CASE k % 7 WHEN 0 THEN 'Yesterday Dr. ' || name || ' spoke' WHEN 1 THEN 'then ' || name || '様 came' WHEN 2 THEN 'with ' || name || ' GmbH today' WHEN 3 THEN 'von 株式会社 ' || name WHEN 4 THEN 'paid € ' || name || ' each' WHEN 5 THEN 'on ' || name || ' at noon' ELSE 'a ' || name || ' b' END"
_NAMES = f"(SELECT k, name, current, {_SAID} AS said FROM (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 4 THEN CAST(c_custkey AS STRINGTYPE) WHEN 5 THEN '2024-01-' || CAST(c_custkey % 28 + 1 AS STRINGTYPE) ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'product' END AS current FROM customer))"
_KIND = "CASE k % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'person' WHEN 2 THEN 'organization' WHEN 3 THEN 'organization' WHEN 4 THEN 'currency' WHEN 5 THEN 'date' ELSE 'unknown' END"
_SURE = "CASE k % 7 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 WHEN 3 THEN 0.85 WHEN 4 THEN 0.9 WHEN 5 THEN 0.75 ELSE 0.0 END"


def candidates(v) -> DataFrame:
    """Customers' names in sentences, with what stands there refined."""
    rows = v.spark.sql("SELECT * FROM " + _NAMES.replace("STRINGTYPE", "STRING").replace("FROM customer", "FROM {customer}"), customer=v.customer)
    start = F.locate("@", F.expr("replace(said, name, '@')")) - 1
    return rows.withColumn("r", jd.refined(F.col("said"), start, F.col("name"))).select("k", "current", "r.kind", "r.confidence")


_DUCK_NAMES = _NAMES.replace("STRINGTYPE", "VARCHAR")
query("sec.heuristic_refine", f"SELECT k, {_KIND} AS kind, CAST({_SURE} AS DOUBLE) AS confidence FROM {_DUCK_NAMES}")(lambda v: candidates(v).select("k", "kind", "confidence"))
query("sec.apply_refinement", f"SELECT k, CASE WHEN {_SURE} >= 0.8 THEN {_KIND} ELSE current END AS kind FROM {_DUCK_NAMES}")(lambda v: candidates(v).select("k", jd.apply_refinement(F.col("current"), F.col("kind"), F.col("confidence"), 0.8).alias("kind")))
query("sec.id_domain", "SELECT domain, family, count(*) AS found FROM (SELECT arg_min(family, place) AS family FROM (" + _EACH + ") GROUP BY doc_id, content) JOIN (VALUES " + ", ".join(f"('{f}', '{d}')" for f, d in _PAIRS) + ") t(family, domain) USING (family) GROUP BY ALL")(
    lambda v: ent.typed_entities(v.texts).withColumn("domain", F.create_map(*[x for d, fs in _DOMAIN.items() for f in fs for x in (F.lit(f), F.lit(d))])[F.col("family")]).where("domain IS NOT NULL").groupBy("domain", "family").agg(F.count("*").alias("found")))

_FOUND = r"""SELECT doc_id, 0 AS place, 'mention' AS kind, 0.85 AS confidence, unnest(regexp_extract_all(text, '@[A-Za-z0-9_]+')) AS content FROM texts
    UNION ALL SELECT doc_id, 3, 'url', 0.9, u FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s,;)\]]*')), '[.!?\"'']+$', '') AS u FROM texts) WHERE length(u) > 8
    UNION ALL SELECT doc_id, 4, 'email', 0.9, w FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '[\s,;<>]')), '^[.!?\"''()]+', ''), '[.!?\"''()]+$', '') AS w FROM texts) WHERE regexp_matches(w, '^[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]*\.[A-Za-z0-9.\-]*$')
    UNION ALL SELECT doc_id, 6, 'number', 0.7, unnest(regexp_extract_all(text, '\$[0-9,.]+[kKmMbB]?')) FROM texts"""
query("txt.extract_entities", f"SELECT doc_id, arg_min(kind, place) AS kind, content, CAST(arg_min(confidence, place) AS DOUBLE) AS confidence FROM ({_FOUND}) GROUP BY doc_id, content")(lambda v: exr.entities(v.texts, kinds=("mention", "url", "email", "number")))

# ---- prompts and routing

SYSTEMS = {"channel": "Recap the channel.", "domain": "Find the themes.", "tenant": "State the policies."}
_TIER = "CASE conv_id % 3 WHEN 0 THEN 'channel' WHEN 1 THEN 'domain' ELSE 'tenant' END"
_SYSTEM = "CASE conv_id % 3 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SYSTEMS.values())) + " END"
query("sec.prompt_build", f"""SELECT conv_id AS scope_id, {_TIER} AS tier, count(*)::INT AS inputs, md5(any_value({_SYSTEM}) || chr(10) || chr(10) || '--- ' || any_value({_TIER}) || ' synthesis inputs ---' || chr(10) || string_agg('[' || CAST(n - 1 AS VARCHAR) || '] ' || left(text, 80) || chr(10), '' ORDER BY n)
    || chr(10) || '--- end inputs ---' || chr(10) || 'Produce the ' || any_value({_TIER}) || ' synthesis output following the grammar constraints. Output only the JSON object, no preamble or explanation.') AS digest
    FROM (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id""")(
    lambda v: jd.prompts(v.conversations.select(F.col("conv_id").alias("scope_id"), F.element_at(F.array(*map(F.lit, SYSTEMS)), (F.col("conv_id") % 3 + 1).cast("int")).alias("tier"), F.col("turn").alias("at"), F.lit(0).alias("id"), F.col("text").alias("body")), SYSTEMS, 4, 80).select("scope_id", "tier", "inputs", F.md5("prompt").alias("digest")))

_SEEN = f"""gives AS ({_GIVES}), held(object_id, type, id, relation) AS (
    SELECT t.object_id, t.subject_type, t.subject_id, t.subject_relation FROM tuples t JOIN gives g ON g.held = t.relation AND g.given = 'viewer' WHERE t.object_type = 'scope'
    UNION SELECT h.object_id, t.subject_type, t.subject_id, t.subject_relation FROM held h JOIN tuples t ON t.object_type = h.type AND t.object_id = h.id JOIN gives g ON g.held = t.relation AND g.given = h.relation),
    seen AS (SELECT DISTINCT 's' || substr(object_id, 7) AS scope_id FROM held WHERE relation IS NULL AND type = 'user' AND id = 'user12')"""


def routed(v) -> DataFrame:
    """Communities by their labels and definitions, for a user who sees some of the scopes."""
    own = _parts(v).join(v.nodes, "id").groupBy("component").agg(F.array_sort(F.collect_set("label")).alias("concepts"), F.array_sort(F.collect_set("scope_id")).alias("scopes"), F.min("definition").alias("summary"))
    seen = gov.reachable(v.tuples, "scope", "viewer", Scratch(v.spark, "seen")).where("subject_id = 'user12'").select(F.concat(F.lit("s"), F.substring("object_id", 7, 9)).alias("scope_id"))
    return jd.route_communities(own.withColumnRenamed("component", "id"), seen, ["nation", "customer", "1"], 12)


query("win.community_route", _PARTS.replace("WITH RECURSIVE", "WITH RECURSIVE " + _SEEN + ",", 1) + """ SELECT component AS id, CAST(score AS INT) AS score FROM (SELECT p.component, 2 * sum(0) + sum(DISTINCT 0) AS zero, 2 * len([c for c in list(DISTINCT lower(n.label)) if contains(c, 'nation')]) + 2 * len([c for c in list(DISTINCT lower(n.label)) if contains(c, 'customer')]) + 2 * len([c for c in list(DISTINCT lower(n.label)) if contains(c, '1')])
    + CASE WHEN contains(lower(min(n.definition)), 'nation') THEN 1 ELSE 0 END + CASE WHEN contains(lower(min(n.definition)), 'customer') THEN 1 ELSE 0 END + CASE WHEN contains(lower(min(n.definition)), '1') THEN 1 ELSE 0 END AS score,
    bool_and(n.scope_id IN (SELECT scope_id FROM seen)) AS shown FROM parts p JOIN nodes n ON n.id = p.id GROUP BY p.component) WHERE shown AND score > 0 ORDER BY score DESC, component LIMIT 12""".replace("2 * sum(0) + sum(DISTINCT 0) AS zero, ", ""))(routed)

# ---- adjudication and promotion

_EVENTS = "(SELECT actor AS id, CASE action WHEN 'signup' THEN 'detect' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'resolve' END AS kind, moment, id AS n FROM audit WHERE action IN ('signup', 'click', 'purchase'))"


def adjudicated(v) -> DataFrame:
    kind = F.when(F.col("action") == "signup", "detect").when(F.col("action") == "click", "review").when(F.col("action") == "purchase", "resolve")
    return v.audit.select(F.col("actor").alias("id"), kind.alias("kind"), F.struct("moment", F.col("id").alias("n")).alias("t")).where("kind IS NOT NULL")


query("sec.adj_detect", f"SELECT id, min(moment) AS detected_at, count(*) - 1 AS refused FROM {_EVENTS} WHERE kind = 'detect' GROUP BY id")(
    lambda v: (lambda e: gr.adjudicate(e).select("id").join(e.where("kind = 'detect'").groupBy("id").agg(F.min("t").alias("first"), (F.count("*") - 1).alias("refused")), "id").select("id", F.col("first.moment").alias("detected_at"), "refused"))(adjudicated(v)))
query("sec.adj_review", f"""WITH e AS {_EVENTS}, d AS (SELECT id, min((moment, n)) AS t FROM e WHERE kind = 'detect' GROUP BY id), r AS (SELECT e.id, min((e.moment, e.n)) AS t FROM e JOIN d ON d.id = e.id AND (e.moment, e.n) > d.t WHERE e.kind = 'resolve' GROUP BY e.id),
    u AS (SELECT e.id, min((e.moment, e.n)) AS t FROM e JOIN d ON d.id = e.id AND (e.moment, e.n) > d.t LEFT JOIN r ON r.id = e.id WHERE e.kind = 'review' AND (r.t IS NULL OR (e.moment, e.n) < r.t) GROUP BY e.id)
    SELECT d.id, r.id IS NULL AS open FROM d JOIN u USING (id) LEFT JOIN r ON r.id = d.id""")(lambda v: reviewed(v))


def reviewed(v) -> DataFrame:
    """Cases that were taken under review, and whether they still are: those whose review a resolve didn't come before."""
    found = gr.adjudicate(adjudicated(v))
    without = gr.adjudicate(adjudicated(v).where("kind <> 'review'")).select("id", F.col("refused").alias("before"))
    reviews = adjudicated(v).where("kind = 'review'").groupBy("id").agg(F.count("*").alias("reviews"))
    # one review is legal where the refusals are one fewer than all reviews add
    legal = found.join(without, "id").join(reviews, "id").where(F.col("refused") < F.col("before") + F.col("reviews"))
    return legal.select("id", (F.col("state") != "resolved").alias("open"))


_LEVEL = "CASE sensitivity WHEN 'noise' THEN 0 WHEN 'useful' THEN 1 WHEN 'important' THEN 2 ELSE 3 END"
query("flt.promotion", f"SELECT id, CASE WHEN importance < 1 THEN 'below_importance_floor' WHEN corroboration_count < 2 THEN 'insufficient_corroboration' WHEN noise > 0.2 THEN 'batch_too_noisy' ELSE 'promoted' END AS reason FROM (SELECT *, avg(CASE WHEN importance = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY scope_id) AS noise FROM (SELECT *, {_LEVEL} AS importance FROM memory))")(
    lambda v: jd.promotion(v.memory.withColumn("importance", F.expr(_LEVEL)), ["scope_id"], 1, 2, 0.2).select("id", "reason"))

# ---- roles and permissions

_NAME = "CASE k % 5 WHEN 0 THEN 'knowledge:tenant:' || u || ':admin' WHEN 1 THEN 'knowledge:tenant:' || u || ':member' WHEN 2 THEN 'knowledge:tenant:' || u || ':emperor' WHEN 3 THEN 'knowledge:group:' || u || ':admin' ELSE 'staff ' || u END"
_GROUPED = f"(SELECT k, u, {_NAME} AS name FROM (SELECT c_custkey AS k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, CASE WHEN c_custkey % 4 = 0 THEN 11 ELSE 12 END) AS u FROM (SELECT c_custkey, md5(CAST(c_custkey AS STRINGTYPE)) AS h FROM customer)))"
query("sec.scim_role_parse", f"SELECT k, CASE WHEN ok THEN u END AS tenant_id, CASE WHEN ok THEN CASE k % 5 WHEN 0 THEN 'admin' ELSE 'member' END END AS role FROM (SELECT k, u, k % 5 < 2 AND k % 4 <> 0 AS ok FROM {_GROUPED.replace('STRINGTYPE', 'VARCHAR')})")(
    lambda v: v.spark.sql("SELECT * FROM " + _GROUPED.replace("STRINGTYPE", "STRING").replace("FROM customer", "FROM {customer}"), customer=v.customer).withColumn("r", jd.group_role(F.col("name"), "knowledge", "tenant", ["admin", "editor", "member", "viewer"])).select("k", "r.tenant_id", "r.role"))
query("graph.permission_closure", f"SELECT t.object_type, g.held, g.given, count(*) AS tuples FROM tuples t JOIN ({_GIVES}) g ON g.held = t.relation GROUP BY ALL")(
    lambda v: v.tuples.groupBy("object_type", F.col("relation").alias("held")).agg(F.count("*").alias("tuples")).select("object_type", "held", F.explode(F.create_map(*[x for h, gs in gov.IMPLIES.items() for x in (F.lit(h), F.array(*map(F.lit, gs)))])[F.col("held")]).alias("given"), "tuples"))
query("sec.ns_implies", f"SELECT object_id, count(*) AS tuples FROM tuples WHERE relation IN (SELECT held FROM ({_GIVES}) WHERE given = 'viewer') GROUP BY object_id")(
    lambda v: v.tuples.where(F.col("relation").isin(gov.covering("viewer"))).groupBy("object_id").agg(F.count("*").alias("tuples")))
_STATE = "CASE action WHEN 'error' THEN 'suspended' WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'deleted' END"
query("lc.tenant_states", f"""SELECT from_state, to_state, (from_state = 'active' AND to_state IN ('suspended', 'deleted')) OR (from_state = 'suspended' AND to_state IN ('active', 'deleted')) AS legal, count(*) AS n FROM (
    SELECT lag(state) OVER (PARTITION BY actor ORDER BY moment, id) AS from_state, state AS to_state FROM (SELECT *, {_STATE} AS state FROM audit) WHERE state IS NOT NULL) WHERE from_state IS NOT NULL GROUP BY ALL""")(lambda v: moves(v))


def moves(v) -> DataFrame:
    """How often actors' states follow each other, and whether they may."""
    own = v.audit.withColumn("to_state", F.expr(_STATE)).where("to_state IS NOT NULL")
    pairs = own.withColumn("from_state", F.lag("to_state").over(gr.Window.partitionBy("actor").orderBy("moment", "id"))).where("from_state IS NOT NULL")
    legal = ((F.col("from_state") == "active") & F.col("to_state").isin("suspended", "deleted")) | ((F.col("from_state") == "suspended") & F.col("to_state").isin("active", "deleted"))
    return pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).withColumn("legal", legal)


# ---- words and their synonyms

_TOLD = f"(SELECT DISTINCT doc_id, unnest({SEARCHED['word']}) AS term FROM texts)"
_BOTH = f"(SELECT a.term, list_sort(list(DISTINCT b.term)) AS all_ FROM ({_GROUPS}) a JOIN ({_GROUPS}) b ON a.g = b.g GROUP BY a.term)"


def told(v) -> DataFrame:
    """Words of texts that have synonyms. The table of synonyms is a caller's, and of fixed size."""
    words = v.texts.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return words.join(expanded(v.spark), "term")


query("set.synonyms", f"SELECT doc_id, term, array_to_string(all_, '|') AS synonyms FROM {_TOLD} JOIN {_BOTH} USING (term)")(lambda v: told(v).select("doc_id", "term", F.array_join("all", "|").alias("synonyms")))
query("set.are_synonyms", f"SELECT DISTINCT a.doc_id, a.term AS a, b.term AS b FROM (SELECT * FROM {_TOLD} JOIN {_BOTH} USING (term)) a JOIN {_TOLD} b ON a.doc_id = b.doc_id AND a.term < b.term AND list_contains(a.all_, b.term)")(
    lambda v: (lambda t: t.select("doc_id", F.col("term").alias("a"), F.explode("all").alias("b")).where("a < b").join(t.select("doc_id", F.col("term").alias("b")), ["doc_id", "b"]))(told(v)).select("doc_id", "a", "b"))
query("set.fts_expand", f"""SELECT doc_id, term, array_to_string(['"' || x || '"' for x in all_], ' OR ') AS query FROM {_TOLD} JOIN {_BOTH} USING (term)""")(lambda v: told(v).select("doc_id", "term", F.array_join(F.transform("all", tx.escape_query), " OR ").alias("query")))
ROUTES = {"temporal": ["summary", "fts"], "holistic": ["summary", "graph_traversal"], "relational": ["graph_traversal", "semantic_vector"], "point_lookup": ["fts", "raw_evidence"], "other": ["semantic_vector", "fts"]}
_COSTS = "CASE class " + " ".join(f"WHEN '{k}' THEN {min(tx.COST[m] for m in ms)}" for k, ms in ROUTES.items()) + " END"
query("fn.route_cost", f"SELECT doc_id, class, {_COSTS} AS cost FROM (SELECT doc_id, {QCLASS} AS class FROM texts)")(
    lambda v: v.texts.select("doc_id", tx.query_class(F.col("text")).alias("class")).withColumn("cost", F.array_min(F.transform(F.from_json(F.lit(json.dumps(ROUTES)), "map<string,array<string>>")[F.col("class")], lambda m: F.from_json(F.lit(json.dumps(tx.COST)), "map<string,int>")[m]))))

# ---- writes that may come again

_HELD = "(SELECT scope_id, observation_type AS kind, min(state) AS blob FROM memory GROUP BY 1, 2)"
query("sink.save_memory_blob", f"SELECT scope_id, kind, coalesce(n.blob, h.blob) AS blob FROM {_HELD} h FULL JOIN (SELECT scope_id, arg_max(id || ':' || event, (moment, id)) AS blob, kind FROM (SELECT CAST(user_id AS VARCHAR) AS scope_id, 'saved' AS event, CASE event_type WHEN 'signup' THEN 'signup' ELSE 'note' END AS kind, CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS moment FROM events WHERE event_type IN ('signup', 'view')) GROUP BY scope_id, kind) n USING (scope_id, kind)")(
    lambda v: jd.upsert_blobs(v.memory.groupBy("scope_id", F.col("observation_type").alias("kind")).agg(F.min("state").alias("blob")), saved(v)))


def saved(v) -> DataFrame:
    rows = v.events.where("event_type IN ('signup', 'view')").select(F.col("user_id").cast("string").alias("scope_id"), F.when(F.col("event_type") == "signup", "signup").otherwise("note").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("id"))
    # of one moment the greatest id is the last
    last = rows.groupBy("scope_id", "kind", "at").agg(F.max("id").alias("id"))
    return last.select("scope_id", "kind", "at", F.concat("id", F.lit(":saved")).alias("blob"))


query("sink.audit_pg_append", "SELECT id, action FROM audit WHERE id % 3 = 0 UNION ALL SELECT id, 'first' FROM audit WHERE id % 3 <> 0")(lambda v: appended(v))


def appended(v) -> DataFrame:
    """Events that come again with other contents: what is held stays, and of new ones the first is taken."""
    rows = v.audit.select("id", "action", "moment")
    new = rows.select("id", F.lit("second").alias("action"), (F.col("moment") + 1).alias("moment")).union(rows.select("id", F.lit("first"), "moment"))
    return jd.append_once(rows.where("id % 3 = 0"), new, "id", ["moment"]).select("id", "action")
