"""The pipeline's stages against plain Python on the smallest documents, and on odd ones."""

from __future__ import annotations

import corpus_pipeline as cp
from cairn.llm import decontaminate as dec, token_shards as tok
from tests.llm.test_corpus_operators import brute_hits, brute_near, odd_docs


def test_stages_on_odd_documents(spark, sf_dir):
    docs = odd_docs(spark)
    for name, stage in cp.STAGES:
        docs_next = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert docs_next.columns == odd_docs(spark).columns
        docs = docs_next
    assert docs.count() > 0


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = sorted({rows[g][0] for g in brute_near(rows)})
    assert sorted(r["doc_id"] for r in cp.near_dedup_stage(spark, docs, sf_dir).collect()) == want


def test_near_dedup_of_repeated_and_missing_ids(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    docs = odd_docs(spark).where("false").union(spark.createDataFrame([(5, long, "en", "s"), (2, "one text here", "en", "s"), (2, long + " more", "en", "s"), (None, long, "en", "s"), (None, "quite another", "en", "s")], "a bigint, b string, c string, d string").select("*", *[__import__("pyspark").sql.functions.lit(None)] * 8))
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in cp.near_dedup_stage(spark, docs, sf_dir).collect())))
    assert kept == sorted(map(str, [(2, "one text here"), (2, long + " more"), (None, "quite another")]))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = odd_docs(spark).where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_decontamination_drops_what_brute_force_finds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).persist()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    keep = []
    for r in docs.collect():
        n, hits, _ = brute_hits(r["text"], items)
        if not (hits and 20 * hits >= n):
            keep.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in cp.decontaminate_stage(spark, docs, sf_dir).collect()) == sorted(keep)


def test_run_decodes_to_documents_that_all_stages_kept(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = cp.run(spark, sf_dir).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    automaton = dec.Automaton({w: [i] for i, t in items for w in dec.windows(t)})
    for d in {r["doc_id"] for r in rows}:
        n, spans, _ = automaton.find(dec.lower(texts[d]))
        hits = sum(b - a for a, b in spans)
        assert not (hits and 20 * hits >= n)
    tool, end = tok.encoder()
    one = max(rows, key=lambda r: r["n_tokens"])["doc_id"]
    import numpy as np

    ids = [x for r in sorted((r for r in rows if r["doc_id"] == one), key=lambda r: r["seq_no"]) for x in np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist()]
    copies = ids.count(end)
    if copies == 1:
        assert tool.decode(ids[:-1]) == texts[one]


def test_two_runs_in_one_session(spark, sf_dir):
    """The first result is read last."""
    first, second = cp.run(spark, sf_dir), cp.run(spark, sf_dir)
    assert second.count() == first.count() > 0
    assert sorted(r["slot"] for r in first.select("slot").collect()) == list(range(first.count()))


def test_stages_alone_delete_nothing_that_is_held(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = cp.near_dedup_stage(spark, docs, sf_dir)
    cp.decontaminate_stage(spark, docs, sf_dir)
    again = cp.near_dedup_stage(spark, docs, sf_dir)
    cp.token_stage(spark, docs, sf_dir)
    assert kept.count() == again.count() > 0
