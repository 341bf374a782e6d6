"""Queries over mechanisms with a life of their own: stored indexes and versions, thought searches, replicas, schedules, change logs, callers' models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from cairn.operators import callbacks as cb, graph as gr, pairing, postings as ix, replicas as rp, thoughts as th
from cairn.plans.durable import Scratch
from cairn.plans.indexes import index_of, new_store as _store
from cairn.plans.search_queries import SEARCHED
from cairn.plans.text_queries import KEPT
from cairn.registry import query
from cairn.sources.versions import Store, scope_space, vacuum_report
from cairn.streaming import changelog as cl, schedule as sc, working as wk

# ---- a stored index

_GRAMS = {lane: f"list_transform(range(1, greatest(length({SEARCHED[lane]}) - {n} + 2, 1)), lambda i: substr({SEARCHED[lane]}, CAST(i AS BIGINT), {n}))" for lane, n in (("trigram", 3), ("bigram", 2))}
_TERMS = " UNION ALL ".join([f"SELECT 'word' AS lane, doc_id, unnest({SEARCHED['word']}) AS term FROM texts", *[f"SELECT '{lane}', doc_id, unnest({g}) FROM texts WHERE {KEPT} <> ''" for lane, g in _GRAMS.items()]])
query("sink.index_fts", f"SELECT lane, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT lane, doc_id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL) GROUP BY lane")(lambda v: index_totals(v))


def index_totals(v) -> DataFrame:
    """What an index holds, by lane, as it was written."""
    store = _store(v.spark, "index")
    ix.write(store, v.texts, "doc_id", "text")
    # a term's postings are in one folder: it is counted there, and no term is shuffled
    own = store.read(ix.POSTINGS).groupBy("lane", "bucket", "term").agg(F.count("*").alias("n"), F.sum(F.size("positions")).alias("tf"))
    return own.groupBy("lane").agg(F.sum("n").alias("postings"), F.count("*").alias("terms"), F.sum("tf").alias("occurrences"))


_WORDS = f"(' ' || array_to_string({SEARCHED['word']}, ' ') || ' ')"
_STARTS = lambda p: f"contains({_WORDS}, ' {p}')"
_HAS = lambda w: f"contains({_WORDS}, ' {w} ')"
for _op, _text, _sql in (
    ("fts.query", '("of the" OR thin*) NOT in', f"({_HAS('of the')} OR {_STARTS('thin')}) AND NOT {_HAS('in')}"),
    ("fts.query_and", "the + of and NOT (ing OR la*)", f"{_HAS('the of')} AND {_HAS('and')} AND NOT ({_HAS('ing')} OR {_STARTS('la')})"),
    ("fts.query_first", "^the OR ^ein*", f"(starts_with({_WORDS}, ' the ') OR starts_with({_WORDS}, ' ein'))"),
    ("fts.query_near", "NEAR(the and, 1)", f"(regexp_matches({_WORDS}, ' the ([^ ]+ )?and ') OR regexp_matches({_WORDS}, ' and ([^ ]+ )?the '))"),
    ("fts.query_literal", "the-of: AND (", f"{_HAS('the')} AND {_HAS('of')} AND {_HAS('and')}"),
):
    query(_op, f"SELECT doc_id AS doc FROM documents WHERE {_sql}")(lambda v, t=_text: index_of(v.documents, "doc_id", "text").search(t).select("doc"))
for _lane, _text in (("trigram", "プロジェクト"), ("bigram", "会議")):
    query(f"fts.index_{_lane}", f"SELECT doc_id AS doc FROM texts WHERE contains({SEARCHED[_lane]}, '{_text}') AND {KEPT} <> ''")(lambda v, t=_text, n=_lane: index_of(v.texts, "doc_id", "text").search(t, n).select("doc"))

# ---- thought searches

_CONFIDENCE = "CASE relation WHEN 'part_of' THEN 0.9 WHEN 'assigned_to' THEN 0.8 ELSE 0.7 END - 0.01 * length({0})"
_STEPS = " UNION ALL ".join(f"SELECT {a} AS src, {b} AS dst, {_CONFIDENCE.format(b)} AS confidence, relation AS kind FROM edges" for a, b in (("src", "dst"), ("dst", "src")))
BUDGET = th.Budget(depth=3, branches=3, nodes=24)


def steps(v) -> DataFrame:
    """Edges in both directions, surer the shorter the name of where they lead."""
    both = gr.directed(v.edges, "both")
    weight = F.when(F.col("relation") == "part_of", 0.9).when(F.col("relation") == "assigned_to", 0.8).otherwise(0.7)
    return both.select(F.col("from").alias("src"), F.col("to").alias("dst"), (weight - 0.01 * F.length("to")).alias("confidence"), F.col("relation").alias("kind"))


def thought_plans(v) -> DataFrame:
    """A question for each nation and supplier."""
    return th.plan(v.nodes.where("id LIKE 'n%' OR id LIKE 'u%'").select(F.col("id").alias("root"), F.col("id").alias("node")))


def grown(v, order: str) -> DataFrame:
    found = th.search(thought_plans(v), th.by_table(steps(v), BUDGET.branches), Scratch(v.spark, "thoughts"), order, BUDGET)
    return found.select("root", "seq", "node", "depth", F.round("confidence", 6).alias("confidence"), "kind", "turn", "exhausted")


_TREE = """WITH RECURSIVE steps AS ({steps}), kids AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind) AS place FROM steps{where} QUALIFY place <= 3),
    tree(root, node, depth, confidence, kind, path) AS (SELECT id, id, 0, 1.0::DOUBLE, 'question', CAST([] AS BIGINT[]) FROM nodes WHERE id LIKE 'n%' OR id LIKE 'u%'
    UNION ALL SELECT t.root, k.dst, t.depth + 1, k.confidence::DOUBLE, k.kind, list_append(t.path, k.place) FROM tree t JOIN kids k ON k.src = t.node WHERE t.depth < 3)
    SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY depth, path) - 1 AS INT) AS seq, node, depth, round(confidence, 6) AS confidence, kind FROM tree QUALIFY seq < 24"""
query("graph.got_expand_breadth", _TREE.format(steps=_STEPS, where=""))(lambda v: grown(v, "breadth_first").drop("turn", "exhausted"))
for _order in ("depth_first", "best_first", "iterative"):
    query(f"graph.got_expand_{_order}")(lambda v, o=_order: grown(v, o))


def _stubborn():
    """A model that answers for the nodes it is given, and fails whenever one of them ends with 7."""

    def model(rows: list[dict]) -> list:
        if any(r["node"].endswith("7") for r in rows):
            raise RuntimeError("no answer")
        return [True] * len(rows)

    return model


def asked_expander(v) -> th.Expander:
    """Children by a table, where a model agrees; where it fails, a thought leads nowhere."""
    table = th.by_table(steps(v), BUDGET.branches)

    def expand(asked: DataFrame) -> DataFrame:
        said = cb.answered(asked, ["node"], _stubborn, "agreed boolean", lambda row: False, attempts=2)
        return table(said.where("agreed").drop("agreed", "answered_by"))

    return expand


query("udf.expander", _TREE.format(steps=_STEPS, where=" WHERE src NOT LIKE '%7'"))(
    lambda v: th.search(thought_plans(v), asked_expander(v), Scratch(v.spark, "thoughts"), "breadth_first", BUDGET).select("root", "seq", "node", "depth", F.round("confidence", 6).alias("confidence"), "kind"))
query("sec.got_plan_sub", """SELECT conv_id AS root, CAST(0 AS BIGINT) AS place, text AS node, 1.0 AS confidence FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
    UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, text, 0.9 FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1""")(lambda v: asked_plans(v))


def asked_plans(v) -> DataFrame:
    """What a user asks first is the question of a conversation, what they ask later are its parts."""
    from pyspark.sql import Window

    turns = v.conversations.where("role = 'user'").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).select(F.col("conv_id").alias("root"), "place", F.col("text").alias("node"))
    return th.plan(turns.where("place = 0").select("root", "node"), turns.where("place > 0")).withColumn("place", F.col("place").cast("bigint"))


# ---- callers' models


def _recaps():
    """A model that sums a window up from its number of objects, and fails on windows whose number ends with 5."""

    def model(rows: list[dict]) -> list[str]:
        if any(r["id"].endswith("5") for r in rows):
            raise RuntimeError("out of memory")
        return [f"{r['tier']}: {r['status']}" for r in rows]

    return model


query("udf.synthesis", "SELECT id, CASE WHEN id LIKE '%5' THEN 'window ' || id ELSE tier || ': ' || status END AS recap, id LIKE '%5' AS fell_back FROM windows")(
    lambda v: cb.answered(v.windows.select("id", "tier", "status"), ["id", "tier", "status"], _recaps, "recap string", lambda r: f"window {r['id']}", attempts=2).select("id", "recap", (F.col("answered_by") == "fallback").alias("fell_back")))


def run_windows(windows: DataFrame, model, attempts: int = 3) -> DataFrame:
    """``(id, status, recap)`` after one run of an engine: pending windows are complete if the model answers, else failed; others stay."""
    asked = cb.answered(windows.where("status = 'pending'").select("id", "tier", "status"), ["id", "tier", "status"], model, "recap string", lambda row: None, attempts)
    done = asked.select("id", F.when(F.col("answered_by") == "fallback", "failed").otherwise("complete").alias("status"), "recap")
    return done.unionByName(windows.where("status <> 'pending'").select("id", "status", F.lit(None).cast("string").alias("recap")))


query("udf.synthesis_engine", "SELECT id, CASE WHEN status <> 'pending' THEN status WHEN id LIKE '%5' THEN 'failed' ELSE 'complete' END AS status, CASE WHEN status = 'pending' AND id NOT LIKE '%5' THEN tier || ': pending' END AS recap FROM windows")(lambda v: run_windows(v.windows, _recaps))

_NOT = re.compile(r" is not ")


def _denials():
    """Two labels oppose if they are the same but for a "not"."""
    core = lambda label: _NOT.sub(" is ", label.rstrip(".!"))
    return lambda pairs: [core(a["label"]) == core(b["label"]) and bool(_NOT.search(a["label"])) != bool(_NOT.search(b["label"])) for a, b in pairs]


query("udf.opposes", """SELECT a.id AS left_id, b.id AS right_id FROM claims a JOIN claims b ON a.scope_id = b.scope_id AND a.id < b.id AND replace(rtrim(a.label, '.!'), ' is not ', ' is ') = replace(rtrim(b.label, '.!'), ' is not ', ' is ')
    AND contains(a.label, ' is not ') <> contains(b.label, ' is not ')""")(lambda v: pairing.matching_pairs(v.claims, "id", ["scope_id"], ["label"], _denials, piece=8))

# ---- versions


def _told(store: Store, number: int | None = None) -> DataFrame:
    out = None
    for name in sorted(store.version(number).tables):
        rows = store.read(name, number)
        own = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.count(rows.columns[0]).alias("keys"))
        out = own if out is None else out.unionByName(own)
    return out


def _engine_tables(v) -> dict[str, DataFrame]:
    return {"evidence": v.evidence.select("evidence_id", "scope_id", "body"), "memory": v.memory.select("id", "scope_id", "state"), "nodes": v.nodes.select("id", "label", "state")}


def snapshot(v) -> Store:
    store = _store(v.spark, "snapshot")
    store.commit(_engine_tables(v))
    return store


_ROWS = lambda evidence="": f"SELECT 'evidence' AS name, count(*) AS rows, count(evidence_id) AS keys FROM evidence{evidence} UNION ALL SELECT 'memory', count(*), count(id) FROM memory UNION ALL SELECT 'nodes', count(*), count(id) FROM nodes"
query("sink.snapshot", _ROWS())(lambda v: _told(snapshot(v)))


def changed(v) -> Store:
    """A snapshot, and a version behind it in which half of the evidence is gone."""
    store = snapshot(v)
    store.commit({"evidence": store.read("evidence").where("evidence_id % 2 = 0")})
    return store


query("sec.engine_snapshot", _ROWS(" WHERE evidence_id % 2 = 0"))(lambda v: _told(changed(v)))


def restored(v) -> DataFrame:
    store = changed(v)
    return _told(store, store.restore(1))


query("sec.engine_restore", _ROWS())(restored)
query("sec.vacuum_report", "SELECT scope_id, CASE WHEN scope_id IN (SELECT scope_id FROM forgotten) THEN 'forgotten' ELSE 'live' END AS state, count(*) AS rows, CAST(sum(octet_length(encode(body))) AS BIGINT) AS payload_bytes FROM evidence GROUP BY scope_id")(
    lambda v: (lambda store: scope_space(store, "evidence", "scope_id", F.octet_length("body"), v.forgotten).select("scope_id", "state", "rows", "payload_bytes"))(snapshot(v)))


def vacuumed(v) -> DataFrame:
    """What is left of the evidence once the forgotten scopes have been written out of the files."""
    store = snapshot(v)
    vacuum_report(store, "evidence", "scope_id", F.octet_length("body"), v.forgotten)
    return store.read("evidence").groupBy("scope_id").agg(F.count("*").alias("rows"))


query("sec.vacuum_forgotten", "SELECT scope_id, count(*) AS rows FROM evidence WHERE scope_id NOT IN (SELECT scope_id FROM forgotten) GROUP BY scope_id")(vacuumed)

# ---- replicas


def members(v, count: int = 3) -> list[rp.Replica]:
    """Replicas that each hold their own part of the log, with gapless numbers of their own."""
    log = v.op_log.where(F.col("replica") < count).select(F.concat(F.lit("r"), F.col("replica").cast("string")).alias("replica"), "seq", "kind", "value", "tag", "observed_tag")
    out = []
    for k in range(count):
        member = rp.Replica(_store(v.spark, f"replica-{k}"), f"r{k}")
        member.store.commit({rp.OPS: log.where(F.col("replica") == f"r{k}").select("replica", F.col("seq").cast("bigint").alias("seq"), "kind", "value", "tag", "observed_tag")})
        out.append(member)
    return out


_LOG = "(SELECT * FROM op_log WHERE replica < 3)"
_LIVE = f"(SELECT DISTINCT value FROM {_LOG} WHERE kind = 'add' AND tag NOT IN (SELECT observed_tag FROM {_LOG} WHERE kind = 'remove' AND observed_tag IS NOT NULL))"
_SUMMARY = f"SELECT m.name, (SELECT count(*) FROM {_LOG}) AS ops, (SELECT count(*) FROM {_LIVE}) AS elements FROM (VALUES ('r0'), ('r1'), ('r2')) m(name)"


def _states(own: list[rp.Replica]) -> DataFrame:
    out = None
    for m in own:
        n = m.elements().count()
        row = m.ops().agg(F.lit(m.name).alias("name"), F.count("*").alias("ops"), F.lit(n).cast("bigint").alias("elements"))
        out = row if out is None else out.unionByName(row)
    return out


def synced(v) -> DataFrame:
    """After everybody has sent and everybody has read; what was read twice counts once."""
    own, relay = members(v), rp.Relay(_store(v.spark, "relay"))
    for m in own:
        m.push(relay, "log")
    for m in own:
        m.pull(relay, "log")
        again, _ = relay.pull("log", 0)
        m.absorb(again)
    return _states(own)


query("udf.transport", _SUMMARY)(synced)


def met(v) -> DataFrame:
    """Without a relay: each takes from the next what its version vector lacks, twice around."""
    own = members(v)
    for k in (0, 1, 2, 0, 1):
        a, b = own[k], own[(k + 1) % 3]
        b.absorb(a.delta_for(b.vector()))
    return _states(own)


query("st.sync_transport", _SUMMARY)(met)
query("sec.version_vector", "SELECT 'r' || CAST(replica AS VARCHAR) AS replica, max(seq) AS upto, CAST(0 AS INT) AS gaps FROM op_log GROUP BY replica")(
    lambda v: rp.vector(v.op_log.select(F.concat(F.lit("r"), F.col("replica").cast("string")).alias("replica"), F.col("seq").cast("bigint").alias("seq")), 100).select("replica", "upto", F.size("beyond").alias("gaps")))

# ---- streams


def changes_log(v) -> str:
    """The change events as logs, a file for each partition, of one JSON object a line."""
    at = Scratch(v.spark, "changes").root
    events = v.source_events.select("kind", F.col("document_id").cast("string").alias("document_id"), F.concat(F.lit("s"), (F.col("document_id") % 5).cast("string")).alias("scope_id"), (F.col("occurred_at") * 100_000_000 + F.col("event_id")).alias("occurred_at"), F.concat(F.lit("order "), F.col("event_id").cast("string")).alias("title"))
    events.select(F.to_json(F.struct("*")).alias("value")).repartition(4).write.text(at)
    return at


def _changelog(v, stream: bool) -> DataFrame:
    cl.register(v.spark)
    read = v.spark.readStream if stream else v.spark.read
    return read.format("cairn_changelog").option("path", changes_log(v)).option("stretch", 1 << 18).load()


query("scan.source_contract", "SELECT kind, count(*) AS events, count(DISTINCT document_id) AS documents, max(occurred_at * 100000000 + event_id) AS last FROM source_events GROUP BY kind")(
    lambda v: _changelog(v, False).groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("document_id").alias("documents"), F.max("occurred_at").alias("last")))


def _bodies():
    """A source that has no body for every ninth document."""
    return lambda rows: [None if int(r["document_id"]) % 9 == 0 else f"body of {r['title']}" for r in rows]


def piped(v) -> DataFrame:
    """The current documents of each scope, after the pipeline has read all logs as a stream."""
    store = _store(v.spark, "pipeline")
    cl.run(_changelog(v, True), store, _bodies, Scratch(v.spark, "offsets").root).awaitTermination()
    return cl.current(store).groupBy("scope_id").agg(F.count("*").alias("documents"), F.min("body").alias("first"))


query("st.sync_pipeline", """SELECT 's' || CAST(document_id % 5 AS VARCHAR) AS scope_id, count(*) AS documents, min('body of order ' || CAST(event_id AS VARCHAR)) AS first FROM (
    SELECT * FROM source_events QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY occurred_at DESC, event_id DESC) = 1) WHERE kind <> 'deleted' AND document_id % 9 <> 0 GROUP BY 1""")(piped)
query("win.working_memory")(lambda v: wk.replay(v.events.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "value"), "user_id", "event_id", "at", "value", 6, 3 * 86_400.0).select("scope", "id", F.array_join("context", ",").alias("context"), F.array_join(F.transform("left", lambda x: F.concat(x["id"], F.lit(":"), x["why"])), ",").alias("left")))


def tick_commands(v) -> DataFrame:
    """Actors as instances: a sign-up schedules one every twelve hours, errors fail it, purchases succeed, and a view of an event id divisible by 50 ends it."""
    kind = F.when(F.col("action") == "signup", "schedule").when(F.col("action") == "error", "failed").when(F.col("action") == "purchase", "done").when((F.col("action") == "view") & (F.col("id") % 50 == 0), "unschedule")
    return v.audit.select(F.col("actor").alias("instance"), kind.alias("kind"), F.lit(43_200_000).cast("bigint").alias("interval"), (F.col("moment") * 1000).alias("at")).where("kind IS NOT NULL")


query("st.scheduler")(lambda v: sc.replay(tick_commands(v), until=1_706_745_600_000, longest=7 * 86_400_000))
