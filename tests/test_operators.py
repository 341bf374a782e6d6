"""Operators on small inputs whose results are plain to see."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.functions import entities, text as tx
from cairn.operators import fulltext as ft, graph as gr, memory as mem, metrics as met, retrieval as rt, syncing as syn
from cairn.operators.components import connected_components
from cairn.plans.durable import Scratch


def one(spark, column, **values):
    names, row = zip(*values.items(), strict=True)
    return spark.createDataFrame([row], list(names)).select(column.alias("x")).first()["x"]


def texts(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", column.alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("text, value", [("ok", 0), ("", 0), ("12", 1), ("abcd", 0), ("the policy is out", 3), ("policy was not signed", 2), ("launch cancelled", 1), ("a plain remark", 1), ("relaunched", 1), ("the launch is on", 2)])
def test_importance(spark, text, value):
    assert texts(spark, tx.importance(F.col("text")), [text]) == [value]


@pytest.mark.parametrize("claim, negated, core", [("The door isn't open.", True, "the door is open"), ("The door is open", False, "the door is open"), ("It won't ship", True, "it will ship"), ("It is no longer here", True, "it is here"), ("never not", False, ""), ("He doesn’t own it", True, "he own it")])
def test_polarity(spark, claim, negated, core):
    got = texts(spark, tx.polarity(F.col("text")), [claim])[0]
    assert (got["negated"], got["core"]) == (negated, core)


def test_bigrams_cross_gaps_and_need_two(spark):
    assert texts(spark, tx.bigram_query(F.col("text")), ["東京 x 会", "東", "abc"]) == ['"東京" AND "京会"', None, None]


def test_iban_and_octets(spark):
    assert texts(spark, entities.found(F.col("text"), "iban"), ["DE89370400440532013000 DE89370400440532013001"]) == [["DE89370400440532013000"]]
    assert texts(spark, entities.found(F.col("text"), "ip"), ["192.168.0.1 300.1.1.1"]) == [["192.168.0.1"]]


def test_a_pause_of_exactly_the_gap_closes_a_session(spark):
    rows = spark.createDataFrame([("s", 1, 0, "a"), ("s", 2, 1799, "b"), ("s", 3, 3599, "c"), ("s", 4, 3600, "bye /END"), ("s", 5, 3601, "d")], "scope_id string, id int, occurred_at int, body string")
    got = mem.session_table(mem.sessions(rows)).orderBy("session").collect()
    assert [(r["members"], r["boundary"]) for r in got] == [(2, "time_gap"), (2, "explicit_action"), (1, "time_gap")]


def test_archived_objects_resurrect_before_their_age_counts(spark):
    row = {"state": "archived", "retrieval_count": 1, "corroboration_count": 0, "created_at": 0, "last_accessed_at": 0, "consolidated_at": None, "score": 0.0}
    frame = spark.createDataFrame([tuple(row.values())], "state string, retrieval_count int, corroboration_count int, created_at long, last_accessed_at long, consolidated_at long, score double")
    assert frame.select(mem.policy_decision(mem.BUSINESS, 10**10, F.col("score")).alias("d")).first()["d"] == "resurrect"


def test_retention_of_a_pinned_object_has_a_floor(spark):
    frame = spark.createDataFrame([(1, 0, 0, "{}", "noise", 0, 0)], "pin_count int, retrieval_count int, corroboration_count int, metadata string, sensitivity string, created_at long, last_accessed_at long")
    assert frame.select(mem.retention_score(10**9).alias("s")).first()["s"] == pytest.approx(0.9)


def test_quantile_clamps_overflow(spark):
    samples = spark.createDataFrame([("a", 100.0)] * 3 + [("b", 0.004)] * 4, "k string, seconds double")
    got = {r["k"]: r["quantile"] for r in met.quantile(met.histogram(samples, ["k"]), ["k"], 0.5).collect()}
    assert got["a"] == 60.0 and got["b"] == pytest.approx(0.001 + 0.004 * 0.5)


def test_cosine_of_odd_vectors(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([3.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r["c"] for r in frame.select(rt.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_scan_and_index_rank_alike(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red dog"), (3, "a red red fish")], "doc int, body string")
    scan = {r["doc"]: r["score"] for r in ft.search(docs, "doc", "body", ["red", "fish"]).collect()}
    index = ft.postings(docs, "doc", "body", ("word",))
    found = {r["doc"]: r["score"] for r in ft.search_index(index, 3, 10 / 3, ["red", "fish"]).collect()}
    assert scan.keys() == found.keys() == {1, 3} and all(scan[d] == pytest.approx(found[d]) for d in scan)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300), (None, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b", Scratch(spark, "t")).collect()}
    assert {found[i] for i in range(1, 41)} == {1} and {found[i] for i in range(100, 160)} == {100} and {found[i] for i in (200, 201, 202)} == {200} and 300 not in found


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b", Scratch(spark, "t")).count() == 0


def test_traversal_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "r", "s"), ("e2", "b", "c", "r", "s"), ("e3", "c", "a", "r", "s")], "id string, src string, dst string, relation string, scope_id string")
    got = {r["id"]: r["depth"] for r in gr.traverse(edges, spark.createDataFrame([("a",)], "id string"), 10, Scratch(spark, "t")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_merging_logs_is_commutative_and_idempotent(spark):
    schema = "replica int, seq int, kind string, value string, tag string, observed_tag string"
    a = spark.createDataFrame([(1, 1, "add", "x", "t1", None), (1, 2, "add", "y", "t2", None)], schema)
    b = spark.createDataFrame([(2, 1, "remove", "x", None, "t1"), (2, 2, "add", "x", "t3", None)], schema)
    state = lambda log: sorted((r["value"], r["tag"]) for r in syn.live_adds(log).collect())
    assert state(syn.merge_logs(a, b)) == state(syn.merge_logs(b, a)) == state(syn.merge_logs(a, b, a)) == [("x", "t3"), ("y", "t2")]


def test_watermark_lets_through_what_it_has_not_seen(spark):
    events = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 4)], "id int, t int").withColumn("k", F.lit("k"))
    marks = syn.watermark(events.where("id = 1"), ["k"], "t", "id")
    assert sorted(r["id"] for r in syn.after_watermark(events, marks, ["k"], "t", "id").collect()) == [2, 3]
