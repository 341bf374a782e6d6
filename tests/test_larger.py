"""Queries and operators on what the smallest dataset doesn't have: ids of larger tables, batches of many words, long sentences, many copies."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import TABLES, rows_of, sql_rows

from cairn import catalog
from cairn.functions import plugins, text as tx
from cairn.operators import evidence as ev, postings as ix, retrieval as rt
from cairn.operators.relational import spread
from cairn.streaming import changelog as cl


@pytest.fixture(scope="module")
def later(spark, sf_dir, tmp_path_factory):
    """The smallest dataset, with every second document once more under an id of a table of 0.1 GB."""
    root = str(tmp_path_factory.mktemp("later"))
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", f"{root}/{t}.parquet")
    docs = f"'{sf_dir}/documents.parquet'"
    duckdb.execute(f"copy (select * from {docs} union all select * replace (doc_id + 46000 as doc_id) from {docs} where doc_id % 2 = 0) to '{root}/documents.parquet'")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return root, con


@pytest.mark.parametrize("name", ["agg_search_clustered", "fn_recency", "join_hybrid_fanin", "win_topk_hybrid", "win_topk_recency"])
def test_times_after_the_moment_count_as_in_the_sql(spark, later, name):
    root, con = later
    frame = catalog.queries()[name](spark, root)
    columns = sorted(frame.columns)
    assert rows_of(frame, columns) == sql_rows(con, catalog.oracle_sql()[name], columns)


def test_a_time_to_come_counts_as_now_unless_told_otherwise(spark):
    got = spark.range(1).select(rt.recency(100, F.lit(107), 7).alias("now"), rt.recency(100, F.lit(107), 7, ahead=True).alias("ahead"), rt.recency(100, F.lit(93), 7, ahead=True).alias("past")).first()
    assert tuple(got) == (1.0, 2.0, 0.5)


# ---- the stored index


def test_an_index_groups_a_bounded_number_of_terms_at_once():
    counts = [3, 0, 4, 20, 1, 1, 9, 2, 0]
    rows = pa.RecordBatch.from_pydict({"i": list(range(len(counts))), "n": pa.array(counts, pa.int32())})
    parts = list(ix._parts(rows, 8))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(counts)))
    assert all(sum(p.column("n").to_pylist()) <= 8 or p.num_rows == 1 for p in parts) and len(parts) == 5


def test_a_worker_gets_few_rows_of_an_index_and_the_setting_comes_back(spark, tmp_path, monkeypatch):
    from cairn.sources.versions import Store

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    commit = Store.commit
    monkeypatch.setattr(Store, "commit", lambda *a, **k: (seen.append(spark.conf.get(name)), commit(*a, **k))[1])
    docs = spark.createDataFrame([(i, f"red fish {i} 会議") for i in range(40)], "id int, text string")
    store = Store(spark, f"file://{tmp_path}/index")
    ix.write(store, docs, "id", "text")
    assert seen == [str(ix.ROWS)] and spark.conf.get(name) == before
    assert ix.Index(store).search("fish 7").select("doc").collect() == [(7,)] and ix.Index(store).search("会議", "bigram").count() == 40


def test_a_table_in_one_row_group_is_worked_on_by_all_cores(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    duckdb.execute(f"copy (select i as id, md5(i::varchar) as text from range(20000) t(i)) to '{at}'")
    rows = spark.read.parquet(at)
    sizes = spread(rows, share=1 << 10).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 20000 / 2
    assert spread(rows, share=1 << 10).exceptAll(rows).count() == 0


def test_texts_without_wide_characters_are_told_apart_as_before(spark):
    texts = ["", None, "plain", "é ñ ß", "\u0dff", "\u0e00x", "a会議b です", "で会の議", "𠀀x", "😀", "a\nท b", "ｶﾀ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = F.col("text")
    stop, none = tx.any_of(tx.RECALL_STOPWORDS), f"[^{tx.UNSEGMENTED}]"
    bare = F.regexp_replace(t, stop, " ")
    plain = [F.regexp_replace(t, none, ""), bare, F.regexp_replace(bare, none, ""), t.rlike(f"[{tx.UNSEGMENTED}]")]
    fast = [tx.unsegmented_only(t), tx.strip_stopwords(t), tx.searched_unsegmented(t), tx.has_unsegmented(t)]
    for r in rows.select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"c{k}") for k, (a, b) in enumerate(zip(plain, fast, strict=True))]).collect():
        assert all(c["a"] == c["b"] for c in r), r


# ---- evaluation, references, keywords, change logs


def test_pairs_of_references_come_once_and_are_not_kept(spark):
    rows = [(i, key, str(i % m)) for i in range(60) for key, m in (("user", 3), ("k", 4), ("z", 60))] + [(1, "user", "1"), (7, None, "0"), (8, "user", None)]
    refs = spark.createDataFrame(rows, "evidence_id int, ref_key string, ref_value string")
    ids = spark.createDataFrame([(0,), (7,), (7,), (99,)], "evidence_id int")
    found = ev.cross_references(refs, ids)
    want = sorted((a, b) for a in (0, 7) for b in range(60) if a != b and (a % 3 == b % 3 or a % 4 == b % 4))
    assert sorted(map(tuple, found.collect())) == want
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in top[: next(i for i, line in enumerate(top) if "Join Inner" in line)])


def test_a_stretch_is_read_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(cl, "_ROWS", 4)
    (tmp_path / "a").write_bytes(b"".join(b'{"kind":"created","document_id":"%d","occurred_at":%d}\n' % (i, i) for i in range(9)) + b"no json\n\n")
    part = cl.ChangelogBatch(str(tmp_path), 1 << 20).partitions()
    got = list(cl.rows(str(tmp_path), part[0]))
    assert [b.num_rows for b in got] == [4, 4, 2]
    assert [r["document_id"] for b in got for r in b.to_pylist()] == [*map(str, range(9)), None]


def test_evaluation_takes_items_in_order_without_python(spark):
    made = spark.createDataFrame([(1, "a", "XY"), (1, "a", "xyz"), (1, "a", "q"), (2, "a", "xy"), (2, "b", "n")], "case_id int, kind string, content string")
    want = spark.createDataFrame([(1, "a", "x"), (1, "a", "yz"), (1, "a", "Y"), (3, "b", "n")], "case_id int, kind string, content string")
    found = plugins.evaluate(made, want)
    assert {r["kind"]: (r["tp"], r["fp"], r["fn"]) for r in found.collect()} == {"a": (2, 2, 1), "b": (0, 1, 1)}
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def test_importance_and_negation_are_judged_at_once(spark):
    texts = [None, "", "ok", "policy was not signed", "launch cancelled", "launch, and not the policy", "policy. launch cancelled", "no keyword at all", "x" * 50 + " policy " + "y" * 40 + " not"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.judged(F.col("text")).alias("j"), tx.importance(F.col("text")).alias("importance"))
    got = [(r["j"]["importance"], r["j"]["negated"]) for r in rows.collect()]
    assert [g[0] for g in got] == [r["importance"] for r in rows.collect()]
    assert [g[1] for g in got] == [False, False, False, True, True, True, True, False, False]


def test_a_search_without_an_index_uses_all_cores_and_counts_overlaps(spark, tmp_path):
    from cairn.operators import fulltext as ft

    at = str(tmp_path / "t.parquet")
    duckdb.execute(f"copy (select i as id, case when i % 5 = 0 then '会会会 x' else 'plain' end as text from range(4000) t(i)) to '{at}'")
    tasks = spark.sparkContext.defaultParallelism
    got = ft.search(spark.read.parquet(at), "id", "text", ["会会"], "bigram")
    assert got.count() == 800 and len(got.inputFiles()) >= tasks
    one = spark.createDataFrame([("会会会",), ("plain",), ("",)], "t string").select(ft._count(F.col("t"), "会会", "bigram").alias("n"))
    assert [r["n"] for r in one.collect()] == [2, 0, 0]
