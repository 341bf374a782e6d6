"""Queries over text functions and typed entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import entities as ent, text as tx
from cairn.operators import extraction as exr
from cairn.operators.relational import spread
from cairn.registry import query


def _q(s: str) -> str:
    """A string literal of the other engine."""
    return "'" + s.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"




def T():  # noqa: N802
    """The text column; columns exist only while Spark runs."""
    return F.col("text")


LOW = "lower(trim(text))"
NOISE = f"({LOW} = '' OR (length({LOW}) < 5 AND NOT regexp_matches({LOW}, '[0-9]')) OR {LOW} IN {_in(tx.NOISE_TOKENS + tx.NOISE_PHRASES)})"


def _class(words: list[str], value: int) -> str:
    pattern = _q(tx.whole_word(words))
    found, lead = f"regexp_extract({LOW}, {pattern}, 2)", f"regexp_extract({LOW}, {pattern}, 1)"
    moment = f"(strpos({LOW}, regexp_extract({LOW}, {pattern}, 0)) + length({lead}))"
    around = f"substr({LOW}, greatest({moment} - 30, 1), least(30, {moment} - 1)) || ' | ' || substr({LOW}, {moment} + length({found}), 30)"
    return f"CASE WHEN regexp_matches({LOW}, {pattern}) THEN CASE WHEN regexp_matches({around}, {_q(tx.whole_word(tx.NEGATIONS))}) THEN {value - 1} ELSE {value} END END"


IMPORTANCE = f"CASE WHEN {NOISE} THEN 0 ELSE coalesce({_class(tx.CRITICAL_KEYWORDS, 3)}, {_class(tx.IMPORTANT_KEYWORDS, 2)}, 1) END"
query("txt.importance", f"SELECT doc_id, {IMPORTANCE} AS importance FROM texts")(lambda v: spread(v.texts).select("doc_id", tx.importance(T()).alias("importance")))
query("txt.is_noise", f"SELECT doc_id, {NOISE} AS noise FROM texts")(lambda v: v.texts.select("doc_id", tx.is_noise(T()).alias("noise")))
query("txt.whole_word", f"SELECT doc_id, regexp_extract({LOW}, {_q(tx.whole_word(tx.CRITICAL_KEYWORDS + tx.IMPORTANT_KEYWORDS))}, 2) AS keyword FROM texts")(
    lambda v: v.texts.select("doc_id", F.regexp_extract(F.lower(F.trim(T())), tx.whole_word(tx.CRITICAL_KEYWORDS + tx.IMPORTANT_KEYWORDS), 2).alias("keyword")))
query("txt.negation_nearby", f"SELECT doc_id, coalesce(({_class(tx.CRITICAL_KEYWORDS, 3)}) = 2, ({_class(tx.IMPORTANT_KEYWORDS, 2)}) = 1, false) AS negated FROM texts")(lambda v: spread(v.texts).select("doc_id", tx.negated(T()).alias("negated")))
query("txt.negation_apply", f"SELECT {IMPORTANCE} AS importance, coalesce(({_class(tx.CRITICAL_KEYWORDS, 3)}) = 2, ({_class(tx.IMPORTANT_KEYWORDS, 2)}) = 1, false) AS negated, count(*) AS n FROM texts GROUP BY 1, 2")(
    lambda v: spread(v.texts).select(tx.judged(T()).alias("j")).groupBy("j.importance", "j.negated").agg(F.count("*").alias("n")))
query("flt.pipeline_floor", f"SELECT doc_id FROM texts WHERE {IMPORTANCE} >= 2")(lambda v: v.texts.where(tx.importance(T()) >= 2).select("doc_id"))
CJK, NOT_CJK = _q(f"[{tx.UNSEGMENTED}]"), _q(f"[^{tx.UNSEGMENTED}]")
KEPT = f"regexp_replace(text, {NOT_CJK}, '', 'g')"
query("txt.cjk_any", f"SELECT doc_id, regexp_matches(text, {CJK}) AS unsegmented FROM texts")(lambda v: v.texts.select("doc_id", tx.has_unsegmented(T()).alias("unsegmented")))
query("txt.cjk_codepoint", f"SELECT doc_id, length({KEPT}) AS n FROM texts")(lambda v: v.texts.select("doc_id", F.length(tx.unsegmented_only(T())).alias("n")))
query("txt.cjk_bigrams", f"SELECT doc_id, array_to_string([substr({KEPT}, i, 2) for i in range(1, length({KEPT}))], ' ') AS grams FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.bigrams(T()), " ").alias("grams")))
query("txt.cjk_bigram_query", f"SELECT doc_id, CASE WHEN length({KEPT}) >= 2 THEN array_to_string(['\"' || substr({KEPT}, i, 2) || '\"' for i in range(1, length({KEPT}))], ' AND ') END AS query FROM texts")(
    lambda v: v.texts.select("doc_id", tx.bigram_query(T()).alias("query")))
_ALONE = r"regexp_replace(text, '[\s\x{00A0}\x{3000}]', '', 'g')"
_REST = f"regexp_replace({_ALONE}, {CJK}, '', 'g')"
_LETTERS = rf"regexp_replace({_REST}, '\p{{L}}', '', 'g')"
_DIGITS = rf"regexp_replace({_LETTERS}, '\p{{N}}', '', 'g')"
query("txt.mixed_language", f"SELECT doc_id, length({_ALONE}) AS total, length({_ALONE}) - length({_REST}) AS cjk_family, length({_REST}) - length({_LETTERS}) AS whitespace_segmented, length({_LETTERS}) - length({_DIGITS}) AS digit, length({_DIGITS}) AS symbol FROM texts")(
    lambda v: v.texts.select("doc_id", tx.script_counts(T()).alias("c")).select("doc_id", "c.*"))
query("txt.quality_script", f"SELECT doc_id, CASE WHEN length({_ALONE}) - length({_REST}) > length({_REST}) - length({_LETTERS}) THEN 'unsegmented' ELSE 'segmented' END AS script FROM texts")(
    lambda v: v.texts.select("doc_id", tx.script_counts(T()).alias("c")).select("doc_id", F.when(F.col("c.cjk_family") > F.col("c.whitespace_segmented"), "unsegmented").otherwise("segmented").alias("script")))
query("txt.in_language", f"SELECT doc_id, CASE WHEN language_tag = 'en' THEN length({_REST}) - length({_LETTERS}) >= length({_ALONE}) - length({_REST}) ELSE true END AS in_language FROM texts")(
    lambda v: v.texts.select("doc_id", "language_tag", tx.script_counts(T()).alias("c")).select("doc_id", F.when(F.col("language_tag") == "en", F.col("c.whitespace_segmented") >= F.col("c.cjk_family")).otherwise(True).alias("in_language")))
query("txt.stopword_strip", f"SELECT doc_id, regexp_replace(text, {_q(tx.any_of(tx.RECALL_STOPWORDS))}, ' ', 'g') AS stripped FROM texts")(lambda v: v.texts.select("doc_id", tx.strip_stopwords(T()).alias("stripped")))
query("txt.lane_unicode61", r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS tokens FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.tokens(T()), " ").alias("tokens")))
query("txt.escape_fts", """SELECT doc_id, '"' || replace(text, '"', '""') || '"' AS query FROM texts""")(lambda v: v.texts.select("doc_id", tx.escape_query(T()).alias("query")))
query("txt.hyphen_ident", "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9]-[A-Za-z0-9]') AS hyphenated FROM texts")(lambda v: v.texts.select("doc_id", tx.has_identifier(T()).alias("hyphenated")))
query("txt.literal_fallback", r"""SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(['"' || replace(w, '"', '""') || '"' || CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '*' ELSE '' END for w in p], ' ') END AS query
    FROM (SELECT doc_id, [w for w in regexp_split_to_array(text, '[\s\-]+') if w <> ''] AS p FROM texts)""")(lambda v: v.texts.select("doc_id", tx.literal_fallback(T()).alias("query")))
query("txt.snippet", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS snippet FROM texts")(lambda v: v.texts.select("doc_id", tx.snippet(T(), 60).alias("snippet")))
query("txt.lang_tag", "SELECT DISTINCT language_tag, split_part(lower(trim(language_tag)), '-', 1) AS primary_tag FROM memory")(lambda v: v.memory.select("language_tag", F.substring_index(F.lower(F.trim("language_tag")), "-", 1).alias("primary_tag")).distinct())
_SENT = f"regexp_extract_all(text, {_q(f'[^{tx.SENTENCE_END}]*[{tx.SENTENCE_END}]|[^{tx.SENTENCE_END}]+$')})"
_END = _q(f"[{tx.SENTENCE_END}]$")
query("txt.sentences", f"SELECT doc_id, array_to_string([s for s in [trim(regexp_replace(x, {_END}, '')) for x in {_SENT}] if s <> ''], '|') AS sentences FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(F.transform(tx.sentences(T()), lambda s: s["text"]), "|").alias("sentences")))
query("txt.question", f"SELECT doc_id, len([x for x in {_SENT} if regexp_extract(x, {_END}) IN ('?', '？', '؟') AND trim(regexp_replace(x, {_END}, '')) <> '']) AS questions FROM texts")(
    lambda v: v.texts.select("doc_id", F.size(F.filter(tx.sentences(T()), lambda s: s["terminator"].isin("?", "？", "؟"))).cast("bigint").alias("questions")))
query("txt.first_token", r"SELECT doc_id, regexp_extract(text, '\p{L}+') AS token FROM texts")(lambda v: v.texts.select("doc_id", tx.first_token(T()).alias("token")))
query("txt.first_bigram", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\p{L}+')) >= 2 THEN array_to_string(regexp_extract_all(text, '\p{L}+')[1:2], ' ') END AS bigram FROM texts")(lambda v: v.texts.select("doc_id", tx.first_bigram(T()).alias("bigram")))
query("txt.table_match", r"SELECT doc_id, lower(regexp_extract(text, '\p{L}+')) IN ('what', 'who', 'the', 'call') AS matched FROM texts")(lambda v: v.texts.select("doc_id", F.lower(tx.first_token(T())).isin("what", "who", "the", "call").alias("matched")))
query("txt.at_mentions", "SELECT doc_id, array_to_string(regexp_extract_all(text, '@[A-Za-z0-9_]+'), '|') AS mentions FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.mentions(T()), "|").alias("mentions")))
query("txt.cap_words", r"SELECT doc_id, array_to_string([w for w in regexp_extract_all(translate(text, '’‘ʼ', ''''''''), '[\p{L}'']+') if regexp_matches(w, '^\p{Lu}') AND length(w) >= 2 AND w NOT IN ('The', 'What')], '|') AS words FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(tx.capitalised(T(), ["The", "What"]), "|").alias("words")))
query("txt.urls", r"SELECT doc_id, array_to_string([u for u in [regexp_replace(x, '[.!?\"'']+$', '') for x in regexp_extract_all(text, 'https?://[^\s,;)\]]*')] if length(u) > 8], '|') AS urls FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.urls(T()), "|").alias("urls")))
query("txt.emails", r"SELECT doc_id, array_to_string([w for w in [regexp_replace(regexp_replace(x, '^[.!?\"''()]+', ''), '[.!?\"''()]+$', '') for x in regexp_split_to_array(text, '[\s,;<>]')] if regexp_matches(w, '^[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]*\.[A-Za-z0-9.\-]*$')], '|') AS emails FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(tx.emails(T()), "|").alias("emails")))
_DAYS = _in("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
query("txt.date_refs", rf"SELECT doc_id, array_to_string(list_sort(list_distinct([w for w in regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') if lower(w) IN {_DAYS}])), '|') AS dates, len(regexp_extract_all(text, '[Qq][1-4][ \t]*[0-9]{{4}}(?:[^0-9]|$)')) AS quarters FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(tx.day_or_month(T()), "|").alias("dates"), F.size(tx.quarters(T())).cast("bigint").alias("quarters")))
query("txt.numeric_refs", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\$[0-9,.]+[kKmMbB]?'), '|') AS amounts FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.amounts(T()), "|").alias("amounts")))
query("txt.fact_shape", f"SELECT doc_id, contains(text, ' ') OR length({KEPT}) >= 4 AS fact_shaped FROM texts")(lambda v: v.texts.select("doc_id", tx.fact_shaped(T()).alias("fact_shaped")))
_has = lambda words: f"regexp_matches(lower(text), {_q(tx.any_of(words))})"
QCLASS = f"CASE WHEN {_has(tx.TEMPORAL)} THEN 'temporal' WHEN {_has(tx.HOLISTIC)} THEN 'holistic' WHEN {_has(tx.RELATIONAL)} THEN 'relational' WHEN regexp_matches(lower(text), {_q('^(' + tx.any_of(tx.POINT) + ')')}) THEN 'point_lookup' ELSE 'other' END"
query("txt.query_class", f"SELECT doc_id, {QCLASS} AS class FROM texts")(lambda v: v.texts.select("doc_id", tx.query_class(T()).alias("class")))
query("txt.polarity", r"""SELECT id, CASE WHEN label LIKE '%never not%' THEN false ELSE regexp_matches(label, ' not | no longer |n''t') END AS negated, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, ' (never|not|no longer)', '', 'g'), 'n''t', ''), '[.!]$', ''), '^ +| +$', '')) AS core FROM claims""")(
    lambda v: v.claims.select("id", tx.polarity(F.col("label")).alias("p")).select("id", "p.*"))
query("txt.tokenise_router", r"SELECT doc_id, array_to_string([t for t in regexp_extract_all(lower(text), '[\p{L}\p{N}]+') if octet_length(encode(t)) > 2], ' ') AS terms FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(tx.router_terms(T()), " ").alias("terms")))
query("txt.salient_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct([t for t in regexp_extract_all(lower(text), '[\p{L}\p{N}]+') if length(t) >= 4])), ' ') AS terms FROM texts")(lambda v: v.texts.select("doc_id", F.array_join(F.array_sort(tx.salient_terms(T())), " ").alias("terms")))
query("txt.entity_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct([t for t in regexp_extract_all(text, '[\p{L}\p{N}]+[-._][\p{L}\p{N}._-]*') if length(t) >= 5])), '|') AS terms FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(T(), F.lit(r"[\p{L}\p{N}]+[-._][\p{L}\p{N}._-]*"), 0), lambda t: F.length(t) >= 5))), "|").alias("terms")))
query("txt.content_hash", "SELECT doc_id, sha256(text) AS hash FROM texts")(lambda v: v.texts.select("doc_id", F.sha2("text", 256).alias("hash")))
query("txt.canonical_id", "SELECT id, substr(sha1(kind || '|' || id), 1, 32) AS canonical FROM proposals")(lambda v: v.proposals.select("id", F.substring(F.sha1(F.concat("kind", F.lit("|"), "id")), 1, 32).alias("canonical")))
query("txt.supersedes_edge_id", "SELECT id, superseded_by, sha1(superseded_by || '>' || id) AS edge_id FROM memory WHERE superseded_by IS NOT NULL")(lambda v: v.memory.where("superseded_by IS NOT NULL").select("id", "superseded_by", F.sha1(F.concat("superseded_by", F.lit(">"), "id")).alias("edge_id")))
query("txt.topic_id", "SELECT DISTINCT scope_id, sha256('key' || scope_id) AS topic FROM memory")(lambda v: v.memory.select("scope_id", F.sha2(F.concat(F.lit("key"), "scope_id"), 256).alias("topic")).distinct())
query("txt.form_encode", "SELECT doc_id, replace(url_encode(text), '%20', '+') AS form FROM texts WHERE regexp_matches(text, '^[A-Za-z0-9 ]*$')")(lambda v: v.texts.where(T().rlike("^[A-Za-z0-9 ]*$")).select("doc_id", F.url_encode(T()).alias("form")))
query("txt.cursor_codec", "SELECT scope_id, CAST(max(moment) AS VARCHAR) || '|' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (WHERE moment = m) AS cursor FROM (SELECT *, max(moment) OVER (PARTITION BY scope_id) AS m FROM audit) GROUP BY scope_id")(
    lambda v: v.audit.join(v.audit.groupBy("scope_id").agg(F.max("moment").alias("m")), "scope_id").where("moment = m").groupBy("scope_id", "m").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("ids")).select("scope_id", F.concat(F.col("m").cast("string"), F.lit("|"), "ids").alias("cursor")))
query("txt.connector_source", "SELECT DISTINCT route, CASE WHEN starts_with(route, '/api') THEN 'api' ELSE 'other' END AS family FROM requests")(lambda v: v.requests.select("route", F.when(F.col("route").startswith("/api"), "api").otherwise("other").alias("family")).distinct())

# ---- typed entities

_NAMES = {"iban": "iban", "isin": "isin", "swift": "swift_bic", "lei": "lei", "ticker": "ticker", "icd10": "icd10", "ndc": "ndc", "patent": "patent", "case_no": "case_number", "sku": "sku", "serial": "serial", "asin": "asin", "po": "purchase_order", "invoice": "invoice", "phone": "phone", "ip": "ip", "currency": "currency", "measure": "measurement"}
_REMAINDER = "list_reduce([0] || flatten([CASE WHEN regexp_matches(c, '[0-9]') THEN [CAST(c AS INT)] ELSE [(ascii(c) - 55) // 10, (ascii(c) - 55) % 10] END for c in string_split(substr({0}, 5) || substr({0}, 1, 4), '')]), lambda a, d: (a * 10 + d) % 97) = 1"


#: Word boundaries of the other engine know ASCII only: letters and digits beyond it, of the scripts in the data, become a sign that is part of a word.
PLAIN = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}-\x{3FF}\x{400}-\x{481}\x{48A}-\x{587}\x{5D0}-\x{5EA}\x{620}-\x{64A}\x{660}-\x{669}\x{904}-\x{E4F}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]', '_', 'g')"


def family_sql(name: str) -> str:
    f = ent.BY_NAME[name]
    out = f"regexp_extract_all({PLAIN}, {_q(f.pattern)}, {f.group})"
    if f.upper:
        out = f"[upper(x) for x in {out}]"
    if name == "iban":
        out = f"[x for x in {out} if {_REMAINDER.format('x')}]"
    if name == "ip":
        out = f"[x for x in {out} if len([o for o in string_split(x, '.') if CAST(o AS INT) > 255]) = 0] || [lower(x) for x in regexp_extract_all({PLAIN}, {_q(ent.IPV6)}, 1)]"
    return f"[trim(x) for x in {out}]" if name == "currency" else out


for _op, _name in _NAMES.items():
    query(f"txt.{_op}", f"SELECT doc_id, array_to_string({family_sql(_name)}, '|') AS found FROM texts")(lambda v, name=_name: v.texts.select("doc_id", F.array_join(ent.found(T(), name), "|").alias("found")))
query("txt.iban_checksum", f"SELECT doc_id, x AS iban, {_REMAINDER.format('x')} AS valid FROM (SELECT doc_id, unnest([upper(y) for y in regexp_extract_all({PLAIN}, {_q(ent.BY_NAME['iban'].pattern)}, 1)]) AS x FROM texts)")(
    lambda v: v.texts.select("doc_id", F.explode(F.transform(F.regexp_extract_all(T(), F.lit(ent.BY_NAME["iban"].pattern), 1), F.upper)).alias("iban")).withColumn("valid", ent.iban_valid(F.col("iban"))))
query("txt.ambiguous_ids", rf"SELECT doc_id, array_to_string([t for t in regexp_extract_all({PLAIN}, '\b([A-Z0-9][A-Z0-9\-]{{3,24}}[A-Z0-9])\b', 1) if regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]')], '|') AS ids FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(ent.ambiguous(T()), "|").alias("ids")))
_EACH = " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{f.name}' AS family, unnest({family_sql(f.name)}) AS content FROM texts" for i, f in enumerate(ent.FAMILIES))
query("txt.typed_entities", f"SELECT doc_id, content, arg_min(family, place) AS family FROM ({_EACH}) GROUP BY doc_id, content")(lambda v: ent.typed_entities(v.texts).select("doc_id", "content", "family"))
query("nest.ner_entities", f"SELECT doc_id, count(*) AS entities FROM (SELECT DISTINCT doc_id, content FROM ({_EACH})) GROUP BY doc_id")(lambda v: ent.typed_entities(v.texts).groupBy("doc_id").agg(F.count("*").alias("entities")))

# ---- extraction: sentences as observations

_ROWS = f"""(SELECT doc_id, split_part(lower(coalesce(language_tag, 'en')), '-', 1) AS tag, trim(regexp_replace(x, {_END}, '')) AS content, regexp_extract(x, {_END}) AS terminator FROM (SELECT doc_id, language_tag, unnest({_SENT}) AS x FROM texts))"""


def _said(table: dict[str, list[str]], test: str) -> str:
    """Whether one of the words of the row's language, or of English, passes the test on ``w``."""
    return "CASE tag " + " ".join(f"WHEN {_q(k)} THEN len([w for w in {'[' + ', '.join(map(_q, ws)) + ']' if ws else 'CAST([] AS VARCHAR[])'} if {test}]) > 0" for k, ws in table.items() if k != "en") + f" ELSE len([w for w in {'[' + ', '.join(map(_q, table['en'])) + ']'} if {test}]) > 0 END"


_KIND = f"""CASE WHEN terminator IN ('?', '？', '؟') THEN 'question' WHEN {_said(exr.DECISIONS, 'contains(lower(content), w)')} THEN 'decision'
    WHEN {_said(exr.TASKS, 'contains(lower(content), w)')} OR {_said(exr.VERBS, "regexp_extract(lower(content), chr(92) || 'p' || chr(123) || 'L' || chr(125) || '+') = w")} THEN 'task'
    WHEN octet_length(encode(content)) >= 6 AND (contains(content, ' ') OR length(regexp_replace(content, {NOT_CJK}, '', 'g')) >= 4) THEN 'fact' END"""
_OBS = f"(SELECT doc_id, content, {_KIND} AS kind FROM {_ROWS} WHERE content <> '')"
query("txt.extract", f"SELECT doc_id, content, kind, CAST(CASE kind WHEN 'decision' THEN 0.75 WHEN 'fact' THEN 0.5 ELSE 0.7 END AS DOUBLE) AS confidence FROM {_OBS} WHERE kind IS NOT NULL")(lambda v: exr.observations(v.texts))
query("nest.ner_facts", f"SELECT doc_id, count(*) FILTER (WHERE kind = 'question') AS questions, count(*) FILTER (WHERE kind = 'decision') AS decisions, count(*) FILTER (WHERE kind = 'task') AS tasks, count(*) FILTER (WHERE kind = 'fact') AS facts FROM {_OBS} WHERE kind IS NOT NULL GROUP BY doc_id")(
    lambda v: exr.observations(v.texts).groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("question", "decision", "task", "fact")]))
CHUNK, OVERLAP = 1024, 128
query("nest.chunk", "SELECT doc_id, i AS chunk, i * 896 AS char_start, length(substr(text, 1 + i * 896, 1024)) AS chars, octet_length(encode(substr(text, 1, i * 896))) AS byte_start FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1024 THEN 1 ELSE CAST(ceil((length(text) - 1024) / 896.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE text <> '')")(
    lambda v: v.documents.where("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.when(F.length("text") <= CHUNK, 0).otherwise(F.ceil((F.length("text") - CHUNK) / float(CHUNK - OVERLAP))).cast("int"))).alias("i"))
    .select("doc_id", F.col("i").cast("bigint").alias("chunk"), (F.col("i") * 896).cast("bigint").alias("char_start"), F.length(F.col("text").substr(F.col("i") * 896 + 1, F.lit(CHUNK))).cast("bigint").alias("chars"), F.octet_length(F.col("text").substr(F.lit(1), F.col("i") * 896)).cast("bigint").alias("byte_start")))
