"""Checks and decisions by rule, on rows where each rule decides."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn import catalog
from cairn.operators import judging as jd
from cairn.operators.relational import spread
from cairn.plans import judging_queries


def asserted(frame, key):
    return {(r[key], r["assertion"]): r["passed"] for r in frame.collect()}


def test_verify_retrieval(spark):
    turns = spark.createDataFrame([(1, 2, 10), (2, 2, 20), (3, 1, 30), (4, 0, 40), (5, 1, None)], "turn_id int, importance int, expected_id int")
    hits = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.1), (2, 21, 0.5), (2, 20, 0.0), (5, 50, None), (99, 1, 1.0)], "turn_id int, evidence_id int, score double")
    got = asserted(jd.verify_retrieval(turns, hits), "turn_id")
    name = "retrieval_"
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, name + "nonempty"): True, (1, name + "expected_id_found"): True, (1, name + "scores_positive"): True}
    assert got[2, name + "expected_id_found"] and not got[2, name + "scores_positive"]
    assert not got[3, name + "nonempty"] and not got[3, name + "expected_id_found"] and got[3, name + "scores_positive"]
    assert (4, name + "nonempty") not in got and not got[4, name + "expected_id_found"]
    assert got[5, name + "nonempty"] and not got[5, name + "expected_id_found"] and not got[5, name + "scores_positive"]


def test_verify_forget(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "scope_id string")
    got = asserted(jd.verify_forget(ids("a", "a", "b", "c"), ids("b", "b"), ids("c"), ids("a", "c")), "scope_id")
    assert [got[s, f"forget_{x}"] for s in "abc" for x in ("body_unreadable", "fts_empty", "tombstone_recorded")] == [True, True, True, False, True, False, True, False, True]


def test_regressions_in_both_directions(spark):
    now = spark.createDataFrame([("ms", 1.04), ("slow", 1.06), ("rate", 0.96), ("low", 0.94), ("new", 9.0)], "metric string, value double")
    base = spark.createDataFrame([("ms", 1.0, "lower_is_better"), ("slow", 1.0, "lower_is_better"), ("rate", 1.0, "higher_is_better"), ("low", 1.0, "higher_is_better")], "metric string, baseline double, direction string")
    assert {r["metric"]: r["regressed"] for r in jd.regressions(now, base, 0.05).collect()} == {"ms": False, "slow": True, "rate": False, "low": True, "new": False}


@pytest.mark.parametrize("text, entity, kind, sure", [
    ("Dr. Jane Smith presented", "Jane Smith", "person", 0.85), ("ask 田中 様 now", "田中", "person", 0.8), ("ACME Inc. announced", "ACME", "organization", 0.85), ("das 株式会社 ソニー ist", "ソニー", "organization", 0.85), ("for € 40 each", "40", "currency", 0.9),
    ("on 2024-05-01 at", "2024-05-01", "date", 0.75), ("on 24-5 at", "24-5", "unknown", 0.0), ("by 2024/05/01 at", "2024/05/01", "unknown", 0.0), ("a plain thing", "plain", "unknown", 0.0), ("Dr. " + "x" * 60 + " Bob", "Bob", "unknown", 0.0), ("Dr. ACME Inc.", "ACME", "person", 0.85),
])
def test_refined(spark, text, entity, kind, sure):
    row = spark.createDataFrame([(text, text.index(entity), entity)], "t string, at int, e string").select(jd.refined(F.col("t"), F.col("at"), F.col("e")).alias("r")).first()["r"]
    assert (row["kind"], row["confidence"]) == (kind, sure)


def test_apply_refinement(spark):
    rows = spark.createDataFrame([("unknown", "person", 0.7), ("unknown", "person", 0.69), ("date", None, None)], "a string, b string, c double")
    assert [r[0] for r in rows.select(jd.apply_refinement(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["person", "unknown", "date"]


def test_prompts(spark):
    rows = spark.createDataFrame([("s", "channel", 2, 1, "second"), ("s", "channel", 1, 9, "first one"), ("s", "channel", 2, 2, None), ("s", "channel", 3, 1, "late"), ("t", "domain", 1, 1, "other")], "scope_id string, tier string, at int, id int, body string")
    got = {r["scope_id"]: (r["prompt"], r["inputs"]) for r in jd.prompts(rows, {"channel": "Recap."}, 3, 6).collect()}
    assert got["s"] == ("Recap.\n\n--- channel synthesis inputs ---\n[0] first \n[1] second\n[2] \n\n--- end inputs ---\nProduce the channel synthesis output following the grammar constraints. Output only the JSON object, no preamble or explanation.", 3)
    assert got["t"][0].startswith("\n\n--- domain synthesis inputs ---\n[0] other\n")


def test_group_role(spark):
    u = "12345678-1234-1234-1234-1234567890ab"
    names = [f"k:tenant:{u}:admin", f"k:tenant:{u}:owner", f"k:group:{u}:admin", f"x:tenant:{u}:admin", f"k:tenant:{u[:-1]}:admin", f"k:tenant:{u}:admin:more", "staff", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(jd.group_role(F.col("n"), "k", "tenant", ["admin", "viewer"]).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in rows] == [(u, "admin")] + [None] * 8


def test_promotion_counts_the_noise_of_a_batch(spark):
    rows = [(1, "quiet", 2, 3), (2, "quiet", 1, 3), (3, "quiet", 2, 1), (4, "loud", 2, 3), (5, "loud", 0, 3), (6, "loud", 0, 0), (7, "quiet", 2, 2)]
    got = jd.promotion(spark.createDataFrame(rows, "id int, batch string, importance int, corroboration_count int"), ["batch"], 2, 2, 0.5)
    assert {r["id"]: r["reason"] for r in got.collect()} == {1: "promoted", 2: "below_importance_floor", 3: "insufficient_corroboration", 4: "batch_too_noisy", 5: "below_importance_floor", 6: "below_importance_floor", 7: "promoted"}


def test_route_communities(spark):
    rows = [("a", "about Cats", ["Cat food", "dogs"], ["s1"]), ("b", "nothing", ["cat"], ["s1", "s2"]), ("c", "cats and dogs", ["catcat", "CATS"], ["s1", "s9"]), ("d", "cats", [], []), ("e", "birds", ["owl"], ["s1"])]
    summaries = spark.createDataFrame(rows, "id string, summary string, concepts array<string>, scopes array<string>")
    seen = spark.createDataFrame([("s1",), ("s2",), ("s2",)], "scope_id string")
    assert [(r["id"], r["score"]) for r in jd.route_communities(summaries, seen, ["cat", "dog"], 5).collect()] == [("a", 5), ("b", 2)]
    assert [r["id"] for r in jd.route_communities(summaries, seen, ["cat"], 1).collect()] == ["a"]
    assert jd.route_communities(summaries, seen, [], 5).count() == 0


def test_upserts_and_appends(spark):
    held = spark.createDataFrame([("s", "a", "old"), ("s", "b", "old")], "scope_id string, kind string, blob string")
    new = spark.createDataFrame([("s", "a", 1, "first"), ("s", "a", 2, "last"), ("t", "a", 1, "new")], "scope_id string, kind string, at int, blob string")
    assert sorted(tuple(r) for r in jd.upsert_blobs(held, new).collect()) == [("s", "a", "last"), ("s", "b", "old"), ("t", "a", "new")]
    log = spark.createDataFrame([(1, "held", 0)], "id int, action string, at int")
    more = spark.createDataFrame([(1, "again", 0), (2, "late", 9), (2, "early", 3)], "id int, action string, at int")
    assert sorted(tuple(r) for r in jd.append_once(log, more, "id", ["at"]).collect()) == [(1, "held", 0), (2, "early", 3)]


def test_small_inputs_are_spread(spark):
    small = spark.range(10, numPartitions=1).selectExpr("id", "'x' AS text")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(small, share=0).rdd.getNumPartitions() == 1


def test_no_file_holds_what_was_forgotten(spark, sf_dir, monkeypatch):
    """Neither the evidence nor the index, in any version of theirs that is left."""
    stores, make = {}, judging_queries.new_store
    monkeypatch.setattr(judging_queries, "new_store", lambda s, job: stores.setdefault(job, make(s, job)))
    catalog.queries()["sec_sim_forget"](spark, sf_dir)
    told = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.col("source").isin([f"src{n}" for n in range(3, 25, 7)]).alias("gone"))
    every = {name: spark.read.parquet(*stores[job].files(f"{stores[job].root}/data/{name}")) for job, name in (("forget", "evidence"), ("forget-index", "postings"))}
    for held in (every["evidence"].withColumnRenamed("evidence_id", "doc"), every["postings"]):
        assert {r["gone"] for r in held.join(told, "doc").select("gone").distinct().collect()} == {False}
