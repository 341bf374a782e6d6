"""Queries over names, money, dates, synonyms and labelled spans."""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F

from cairn.functions import cultural as cu, text as tx
from cairn.plans.text_queries import _in, _q
from cairn.functions import lookup as lk
from cairn.operators.relational import top_per
from cairn.registry import query

_STRIPPED = """CASE WHEN regexp_matches(name, '^(Mr|Ms|Mrs|Dr|Prof)[. ]') THEN trim(regexp_replace(name, '^(Mr|Ms|Mrs|Dr|Prof)[. ]', '')) WHEN language_tag = 'ja' AND ends_with(name, '様') THEN trim(left(name, length(name) - 1)) WHEN language_tag = 'zh' AND ends_with(name, '先生') THEN trim(left(name, length(name) - 2))
    WHEN language_tag = 'th' AND starts_with(name, 'คุณ') THEN trim(substr(name, 4)) WHEN language_tag = 'vi' AND starts_with(name, 'Ông ') THEN trim(substr(name, 5)) ELSE name END"""
_HONORIFIC = "CASE WHEN regexp_matches(name, '^(Mr|Ms|Mrs|Dr|Prof)[. ]') THEN trim(regexp_extract(name, '^(Mr|Ms|Mrs|Dr|Prof)[. ]')) WHEN language_tag = 'ja' THEN '様' WHEN language_tag = 'zh' THEN '先生' WHEN language_tag = 'th' THEN 'คุณ' WHEN language_tag = 'vi' THEN 'Ông' END"
_N, _L = lambda: F.col("name"), lambda: F.col("language_tag")
query("txt.honorific", f"SELECT doc_id, {_STRIPPED} AS name, {_HONORIFIC} AS honorific FROM cultural")(lambda v: v.cultural.select("doc_id", cu.strip_honorific(_N(), _L()).alias("s")).select("doc_id", "s.*"))
_ORDER = "CASE WHEN language_tag IN ('ja', 'ko', 'zh', 'vi', 'hu') THEN 'family_first' ELSE 'given_first' END"
query("txt.name_order", f"SELECT doc_id, {_ORDER} AS name_order FROM cultural")(lambda v: v.cultural.select("doc_id", cu.name_order(_N(), _L()).alias("name_order")))
query("txt.person_name", f"""SELECT doc_id, s AS display, CASE WHEN o = 'family_first' THEN CASE WHEN len(w) >= 2 THEN w[1] ELSE left(s, 1) END WHEN len(w) >= 2 THEN w[-1] END AS family,
    CASE WHEN o = 'family_first' THEN CASE WHEN len(w) >= 2 THEN array_to_string(w[2:], ' ') ELSE substr(s, 2) END WHEN len(w) >= 2 THEN array_to_string(w[:-2], ' ') ELSE s END AS given
    FROM (SELECT doc_id, s, o, string_split(s, ' ') AS w FROM (SELECT doc_id, {_STRIPPED} AS s, {_ORDER} AS o FROM cultural))""")(lambda v: v.cultural.select("doc_id", cu.person_name(_N(), _L()).alias("p")).select("doc_id", "p.*"))
query("txt.calendar", "SELECT doc_id, CASE WHEN regexp_matches(dated, '令和|昭和') THEN 'japanese_era' WHEN contains(dated, 'พ.ศ') THEN 'thai_buddhist' WHEN contains(dated, '农历') THEN 'chinese_lunar' WHEN contains(dated, 'AH') THEN 'hijri' ELSE 'gregorian' END AS calendar FROM cultural")(
    lambda v: v.cultural.select("doc_id", cu.calendar(F.col("dated")).alias("calendar")))
_MONEY = {"$1,299.00": ("USD", "1299.00"), "€1.234,56": ("EUR", "1234.56"), "20,5 EUR": ("EUR", "20.5"), "¥12,000": ("JPY", "12000"), "£3.5m": ("GBP", "3.5M"), "1 000 USD": ("USD", "1000"), "7€": ("EUR", "7")}
_money = lambda i: "CASE money " + " ".join(f"WHEN {_q(k)} THEN {_q(x[i])}" for k, x in _MONEY.items()) + " END"
query("txt.currency_norm", f"SELECT doc_id, {_money(0)} AS code, {_money(1)} AS amount FROM cultural")(lambda v: v.cultural.select("doc_id", cu.currency(F.col("money")).alias("m")).select("doc_id", "m.code", "m.amount"))
query("txt.amount_norm", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1234.5' WHEN 1 THEN '1234567' ELSE '12.50K' END AS amount FROM documents")(
    lambda v: v.documents.select("doc_id", cu.amount(F.when(F.col("doc_id") % 3 == 0, "1.234,5").when(F.col("doc_id") % 3 == 1, "1,234,567").otherwise(" 12.50k")).alias("amount")))
query("txt.address_country", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'JP' WHEN 1 THEN 'US' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' END AS country FROM documents")(lambda v: v.cultural.select("doc_id", cu.address_country(F.col("address")).alias("country")))
query("txt.jp_era", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '2024-02-01' WHEN 5 THEN '1989-01-07' END AS iso FROM documents")(lambda v: v.cultural.select("doc_id", cu.japanese_era(F.col("dated")).alias("iso")))
query("txt.thai_be", "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN '2024-02-01' WHEN 6 THEN '1957' END AS iso FROM documents")(lambda v: v.cultural.select("doc_id", cu.thai_buddhist(F.col("dated")).alias("iso")))
query("txt.cn_lunar", "SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN '2024-02-24' END AS iso FROM documents")(lambda v: v.cultural.select("doc_id", F.when(cu.calendar(F.col("dated")) == "chinese_lunar", cu.chinese_lunar(F.col("dated"))).alias("iso")))
query("txt.hijri", "SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN '2024-03-11' END AS iso FROM documents")(lambda v: v.cultural.select("doc_id", cu.hijri(F.col("dated")).alias("iso")))
_ISO = "CASE doc_id % 8 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2024-02-01' WHEN 2 THEN '2024-02-24' WHEN 3 THEN '2024-03-11' WHEN 5 THEN '1989-01-07' WHEN 6 THEN '1957' END"
query("txt.to_iso", f"SELECT doc_id, {_ISO} AS iso FROM documents")(lambda v: v.cultural.select("doc_id", cu.to_iso(F.col("dated")).alias("iso")))
query("txt.enrich", f"SELECT doc_id, {_money(0)} AS code, {_ISO} AS iso, {_ORDER} AS name_order FROM cultural")(
    lambda v: v.cultural.select("doc_id", cu.currency(F.col("money"))["code"].alias("code"), cu.to_iso(F.col("dated")).alias("iso"), cu.name_order(_N(), _L()).alias("name_order")))

# ---- synonyms and lexicons: tables that a caller may replace

SYNONYMS = [["budget", "予算", "预算", "예산"], ["meeting", "会議", "会议", "회의"], ["deadline", "due date", "期限"], ["approval", "approve", "承認", "승인"], ["decision", "decide", "決定", "승인"], ["project", "プロジェクト", "项目"]]
_GROUPS = " UNION ALL ".join(f"SELECT {i} AS g, unnest({json.dumps(g, ensure_ascii=False).replace(chr(34), chr(39))}) AS term" for i, g in enumerate(SYNONYMS))


def synonym_groups(spark):
    """``(g, term)``, a row for each term of a group."""
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(SYNONYMS)), "array<array<string>>")).alias("g", "terms")).select("g", F.explode("terms").alias("term"))


def expanded(spark):
    """Each term with all terms of all of its groups."""
    groups = synonym_groups(spark)
    return groups.join(groups.withColumnRenamed("term", "other"), "g").groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("all"))


INTERROGATIVES = {"en": ["who", "what", "when", "where", "why", "how", "which"], "de": ["wer", "was", "wann", "wo", "warum", "wie"], "fr": ["qui", "que", "quand", "où", "pourquoi", "comment"], "es": ["quién", "qué", "cuándo", "dónde", "por", "cómo"]}
query("txt.interrogatives", "SELECT doc_id, CASE lang " + " ".join(f"WHEN '{k}' THEN lower(regexp_extract(text, '\\p{{L}}+')) IN {_in(w)}" for k, w in INTERROGATIVES.items()) + " ELSE false END AS asks FROM documents")(
    lambda v: v.documents.select("doc_id", F.coalesce(F.array_contains(F.from_json(F.lit(json.dumps(INTERROGATIVES)), "map<string,array<string>>")[F.col("lang")], F.lower(tx.first_token(F.col("text")))), F.lit(False)).alias("asks")))
query("txt.strip_exemplar", "SELECT conv_id, count(*) FILTER (WHERE NOT contains(text, 'the')) AS kept FROM conversations GROUP BY conv_id")(
    lambda v: v.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("t")).select("conv_id", F.size(F.filter("t", lambda x: ~x.contains("the"))).cast("bigint").alias("kept")))

# ---- labelled spans


def spans(v):
    """Runs of one entity: a B begins one, an I of the same type goes on with it."""
    order = Window.partitionBy("doc_id").orderBy("place")
    kind = F.substring("label", 3, 9)
    begins = (F.col("label") != "O") & (F.col("label").startswith("B") | (F.lag("label").over(order).isNull()) | (F.lag("label").over(order) == "O") | (F.substring(F.lag("label").over(order), 3, 9) != kind))
    marked = v.labels_bio.withColumn("kind", kind).withColumn("span", F.sum(begins.cast("int")).over(order)).where("label <> 'O'")
    return marked.groupBy("doc_id", "span").agg(F.min("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("content"))


query("nest.ner_spans", """SELECT doc_id, CAST(span AS BIGINT) AS span, min(substr(label, 3)) AS kind, string_agg(word, ' ' ORDER BY place) AS content FROM (SELECT *, sum(CASE WHEN label <> 'O' AND (starts_with(label, 'B') OR p IS NULL OR p = 'O' OR substr(p, 3) <> substr(label, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS span
    FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY place) AS p FROM labels_bio)) WHERE label <> 'O' GROUP BY 1, 2""")(spans)
query("sec.ner_body", "SELECT doc_id, md5(string_agg(word, ' ' ORDER BY place)) AS digest FROM labels_bio WHERE label <> 'O' GROUP BY doc_id")(
    lambda v: v.labels_bio.where("label <> 'O'").groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ")).alias("digest")))
query("win.missing_entities", r"SELECT doc_id, array_to_string(list_sort(list_distinct([t for t in regexp_extract_all(text, '[\p{L}\p{N}]+') if regexp_matches(t, '[0-9]') AND length(t) >= 5]))[1:15], '|') AS missing FROM texts")(
    lambda v: v.texts.select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0), lambda t: t.rlike("[0-9]") & (F.length(t) >= 5)))), 1, 15), "|").alias("missing")))
_DOMAIN = {"finance": ["iban", "isin", "swift_bic", "lei", "ticker"], "health": ["icd10", "ndc"], "legal": ["patent", "case_number"], "commerce": ["sku", "serial", "asin", "purchase_order", "invoice"], "contact": ["phone", "ip"], "quantity": ["currency", "measurement"]}
_PAIRS = [(f, d) for d, fs in _DOMAIN.items() for f in fs]

# ---- the rest of the thin operators

for _op, _view in (("sec.store_conn_delete", "audit"), ("sec.store_token_delete", "requests")):
    query(_op, f"SELECT tenant_id, count(*) AS n FROM {_view} WHERE tenant_id <> '3' GROUP BY tenant_id")(lambda v, view=_view: getattr(v, view).where("tenant_id <> '3'").groupBy("tenant_id").agg(F.count("*").alias("n")))
query("sec.cassette_rank", "SELECT DISTINCT kind, CASE kind WHEN 'created' THEN 2 WHEN 'updated' THEN 1 ELSE 0 END AS rank FROM source_events")(lambda v: v.source_events.select("kind", F.when(F.col("kind") == "created", 2).when(F.col("kind") == "updated", 1).otherwise(0).alias("rank")).distinct())
query("scan.connector_kinds", "SELECT kind, count(*) AS events FROM source_events GROUP BY kind")(lambda v: v.source_events.groupBy("kind").agg(F.count("*").alias("events")))
_PATH = "'models/' || p_brand || '/net-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 'B.gguf'"
_MARKED = lambda words: " OR ".join(f"contains(regexp_extract(lower(path), '[^/]*$'), '{w}')" for w in words)
query("sec.model_class", f"SELECT id, CASE WHEN {_MARKED(lk.SMALL_MODELS)} THEN 'small' WHEN {_MARKED(lk.MEDIUM_MODELS)} THEN 'medium' ELSE 'large' END AS class FROM (SELECT p_partkey AS id, {_PATH} AS path FROM part)")(
    lambda v: v.part.select(F.col("p_partkey").alias("id"), lk.model_class(F.concat(F.lit("models/"), "p_brand", F.lit("/net-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(""), F.lit("B.gguf"))).alias("class")))
query("sec.trim_array", "SELECT actor, array_to_string((list(action ORDER BY moment, id))[1:3], ',') AS first FROM audit GROUP BY actor")(
    lambda v: v.audit.groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("moment", "id", "action"))).alias("a")).select("actor", F.array_join(F.transform(F.slice("a", 1, 3), lambda x: x["action"]), ",").alias("first")))
query("sec.status_classify", "SELECT id, status IN ('complete', 'failed') AS terminal, status = 'complete' AS success FROM windows")(lambda v: v.windows.select("id", F.col("status").isin("complete", "failed").alias("terminal"), (F.col("status") == "complete").alias("success")))
query("sec.audit_export", "SELECT id, 'export' AS action, actor FROM audit WHERE action = 'view' AND tenant_id = '1'")(lambda v: v.audit.where("action = 'view' AND tenant_id = '1'").select("id", F.lit("export").alias("action"), "actor"))
query("nest.chunk_pipeline", "SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE contains(lower(c), 'the ')) AS english FROM (SELECT doc_id, substr(text, 1 + i * 896, 1024) AS c FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1024 THEN 1 ELSE CAST(ceil((length(text) - 1024) / 896.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE text <> '')) GROUP BY doc_id")(
    lambda v: v.documents.where("text <> ''").select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.length("text") <= 1024, 0).otherwise(F.ceil((F.length("text") - 1024) / 896.0)).cast("int")), lambda i: F.substr("text", i * 896 + 1, F.lit(1024)))).alias("c")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.lower("c").contains("the ")).alias("english")))
query("graph.got_paths", """WITH RECURSIVE p(id, path, depth) AS (SELECT id, id, 0 FROM nodes WHERE id IN ('c50', 'c99') UNION ALL SELECT e.dst, p.path || '>' || e.dst, p.depth + 1 FROM p JOIN edges e ON e.src = p.id WHERE p.depth < 5)
    SELECT path, round(pow(0.95, depth), 6) AS score FROM p WHERE id NOT IN (SELECT src FROM edges)""")(lambda v: paths(v).select("path", "score"))


def paths(v):
    """Paths from roots to leaves, level by level; a level is one join with the edges."""
    steps = v.edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    level = v.nodes.where("id IN ('c50', 'c99')").select("id", F.col("id").alias("path"), F.lit(0).alias("depth"))
    out = level
    for _ in range(5):
        level = level.join(steps, "id").select(F.col("next").alias("id"), F.concat_ws(">", "path", "next").alias("path"), (F.col("depth") + 1).alias("depth"))
        out = out.union(level)
    out = out.withColumn("root", F.substring_index("path", ">", 1))
    return out.join(v.edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("score", F.round(F.pow(F.lit(0.95), F.col("depth")), 6))


query("win.got_best_path", """WITH RECURSIVE p(id, path, depth) AS (SELECT id, id, 0 FROM nodes WHERE id IN ('c50', 'c99') UNION ALL SELECT e.dst, p.path || '>' || e.dst, p.depth + 1 FROM p JOIN edges e ON e.src = p.id WHERE p.depth < 5)
    SELECT split_part(path, '>', 1) AS root, path, round(pow(0.95, depth), 6) AS score FROM p WHERE id NOT IN (SELECT src FROM edges) QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, path) = 1""")(
    lambda v: top_per(paths(v), ["root"], [F.desc("score"), F.asc("path")]).select("root", "path", "score"))
