"""Plug-ins, tables that are written, and streams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import plugins
from cairn.operators import memory as mem
from cairn.sources import store
from cairn.streaming import connectors, limits


def test_embedding_each_content_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        model = plugins.hashing_embedder(8)

        def counted(texts):
            calls.add(len(texts))
            return model(texts)

        return counted

    rows = spark.createDataFrame([(1, "h1", "red fish"), (2, "h1", "red fish"), (3, "h2", "123")], "id int, content_hash string, body string")
    got = {r["id"]: r["embedding"] for r in plugins.embed_contents(rows, factory).collect()}
    assert got[1] == got[2] and got[3] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and calls.value == 1


def test_table_functions(spark):
    spark.udtf.register("extract_words", plugins.extractor(lambda t: [("word", w, 0.5) for w in t.split()]))
    spark.udtf.register("halves", plugins.chunker(lambda t: [t[: len(t) // 2], t[len(t) // 2 :]]))
    assert [r["content"] for r in spark.sql("SELECT e.content FROM (SELECT 'a b' AS t) x, LATERAL extract_words(x.t) e").collect()] == ["a", "b"]
    assert [(r["place"], r["chunk"]) for r in spark.sql("SELECT h.* FROM (SELECT 'abcd' AS t) x, LATERAL halves(x.t) h").collect()] == [(0, "ab"), (1, "cd")]


def test_inference_failures_stay_rows(spark):
    def client(text):
        if text == "bad":
            raise RuntimeError("no answer")
        return text.upper()

    got = plugins.infer(spark.createDataFrame([("ok",), ("bad",)], "p string"), "p", lambda: client, "?").collect()
    assert sorted((r["answer"], r["failed"]) for r in got) == [("?", True), ("OK", False)]


def test_refine_and_classify_and_summarise(spark):
    ents = spark.createDataFrame([("x", "a"), ("y", "b")], "content string, kind string")
    got = plugins.refine(ents, lambda: lambda ts: [("new", 0.9 if t == "x" else 0.1) for t in ts]).collect()
    assert sorted(r["kind"] for r in got) == ["b", "new"]
    assert [r["c"] for r in ents.select(plugins.classifier(lambda: lambda ts: [len(t) for t in ts])(F.col("content")).alias("c")).collect()] == [1, 1]
    obs = spark.createDataFrame([("s", 2, 5, "b"), ("s", 1, 4, "a")], "scope_id string, id int, occurred_at int, body string")
    assert plugins.summarise(mem.sessions(obs), "+".join).first()["summary"] == "a+b"


def test_evaluation_matches_each_item_once(spark):
    made = spark.createDataFrame([(1, "fact", "the sky is blue"), (1, "fact", "the sky"), (2, "task", "x")], "case_id int, kind string, content string")
    want = spark.createDataFrame([(1, "fact", "sky"), (1, "fact", "blue"), (3, "fact", "z")], "case_id int, kind string, content string")
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"]) for r in plugins.evaluate(made, want).collect()}
    assert got == {"fact": (2, 0, 1), "task": (0, 1, 0)}


def test_snapshot_round_trip_and_scope_pruning(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 5}") for i in range(50)], "evidence_id int, scope_id string")
    store.snapshot({"e": rows}, f"file://{tmp_path}/snap")
    assert store.restore(spark, f"file://{tmp_path}/snap", ["e"])["e"].count() == 50
    store.write_evidence(rows, f"file://{tmp_path}/ev", 4)
    found = store.read_scope(spark, f"file://{tmp_path}/ev", "s3", 4)
    assert found.count() == 10 and "PartitionFilters: [isnotnull(scope_bucket" in found._jdf.queryExecution().toString()
    store.write_report(rows, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 50


def test_bundles_are_salvaged(spark):
    rows = spark.createDataFrame([('noise {"recap": "all well", "decisions": ["a"]} tail',), ('{"recap": "cut off he',), ("nothing",)], "raw string")
    got = [r["b"] for r in rows.select(store.parse_bundle(F.col("raw")).alias("b")).collect()]
    assert got[0]["bundle"]["recap"] == "all well" and not got[0]["salvaged"]
    assert got[1]["bundle"]["recap"] == "cut off he" and got[1]["salvaged"] and got[2]["bundle"] is None


def test_quota_windows_begin_with_the_first_request(spark):
    events = spark.createDataFrame([(i, "t", float(at)) for i, at in enumerate([50, 55, 60, 109, 110, 111, 112])], "id int, tenant string, at double")
    got = [r["verdict"] for r in limits.replay(events, "tenant", "at", "id", limits.quota(2, 60)).orderBy("id").collect()]
    assert got == ["admitted", "admitted", "rejected", "rejected", "admitted", "admitted", "rejected"]


def test_bucket_refills_and_rotation_counts_bytes():
    step, state, got = limits.token_bucket(2, 0.5), None, []
    for at in (0, 0, 0, 1, 2, 3):
        state, verdict = step(state, at, 0)
        got.append(verdict)
    assert got == ["admitted", "admitted", "rejected", "rejected", "admitted", "rejected"]
    step, state, epochs = limits.rotation(100, 10), None, []
    for at, size in ((0, 6), (1, 6), (2, 3), (150, 1)):
        state, verdict = step(state, at, size)
        epochs.append(verdict)
    assert epochs == ["0", "1", "1", "2"]
    assert limits.working_set(2, 100)([("a", 1, 0), ("b", 5, 1), ("c", 3, 2), ("d", 9, 300)]) == ["d"]


def test_stream_gives_the_verdicts_of_a_replay(spark, tmp_path):
    rows = [(i, f"t{i % 3}", float(i * 7 % 50 + i)) for i in range(60)]
    events = spark.createDataFrame(rows, "id int, tenant string, at double")
    events.orderBy("at").coalesce(1).write.json(f"file://{tmp_path}/in")
    stream = limits.limit_stream(spark.readStream.schema("id int, tenant string, at double").json(f"file://{tmp_path}/in"), "tenant", "at", "id", limits.cooldown(9), 1)
    stream.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = {(str(r["id"]), r["verdict"]) for r in limits.replay(events, "tenant", "at", "id", limits.cooldown(9)).collect()}
    assert {(r["id"], r["verdict"]) for r in spark.table("verdicts").collect()} == want


def test_change_source_pages_and_syncs_once(spark, tmp_path):
    path = tmp_path / "changes.jsonl"
    events = [{"kind": "created", "document_id": "a", "occurred_at": 1, "title": "A"}, {"kind": "updated", "document_id": "a", "occurred_at": 2, "title": "A2"}, {"kind": "created", "document_id": "b", "occurred_at": 1, "title": "B"}, {"kind": "deleted", "document_id": "b", "occurred_at": 3, "title": None}, {"kind": "created", "document_id": "a", "occurred_at": 1, "title": "A"}]
    path.write_text("\n".join(map(json.dumps, events)))
    connectors.register(spark)
    assert spark.read.format("cairn_changes").option("path", str(path)).load().count() == 5
    out = f"file://{tmp_path}/out"
    stream = spark.readStream.format("cairn_changes").option("path", str(path)).option("page", "2").load()
    query = stream.writeStream.foreachBatch(lambda f, n: f.write.mode("append").parquet(out)).option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    changes = spark.read.parquet(out)
    assert changes.count() == 5
    empty = changes.where("false").select("document_id", "occurred_at", "title")
    assert [(r["document_id"], r["title"]) for r in connectors.upsert(empty, changes).collect()] == [("a", "A2")]


def test_webhooks_keep_bad_bodies(spark):
    rows = spark.createDataFrame([('{"kind": "created", "document_id": "d", "occurred_at": 4}',), ('{"kind": "x", "document_id": "d"}',), ("{",)], "body string")
    assert [r["quarantine"] for r in connectors.parse_webhooks(rows).collect()] == [None, "unknown_kind", "malformed"]
