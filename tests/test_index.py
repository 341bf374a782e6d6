"""A stored index: the query grammar row by row, scores as the scan's, appends, removals, and which files are read."""

from __future__ import annotations

import os
import tempfile

import pytest
import regex
from pyspark.sql import functions as F

from cairn.functions import querytext as qt
from cairn.operators import fulltext as ft, postings as ix
from cairn.sources.versions import Store

TEXTS = {
    1: "The red fish swims. The blue fish does not.", 2: "Red river, blue fish", 3: "fish red", 4: "", 5: None, 6: "Order BR-2505 shipped; see FA-2025-0411.", 7: "red red red fish fish", 8: "a fishing trip to the red river banks with nothing else but fish",
    9: "会議でプロジェクトの予算を決める", 10: "プロジェクト会議 and 2505가 are here", 11: "NOT AND OR near", 12: "blue whale and red herring or fishes", 13: "the the the", 14: "The red fish swims. The blue fish does not.",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id int, text string").withColumn("bucket", F.lit("own"))


@pytest.fixture(scope="module")
def store(spark, docs):
    out = Store(spark, "file://" + tempfile.mkdtemp(prefix="cairn-index-"))
    ix.write(out, docs.where("id <= 7"), "id", "text", buckets=8)
    ix.write(out, docs.where("id > 7"), "id", "text", append=True, buckets=8)
    return out


@pytest.fixture(scope="module")
def index(store):
    return ix.Index(store)


def starts(phrase, words):
    want = [w for t in phrase.texts for w in qt.words(t)]
    out = []
    for at in range(len(words) - len(want) + 1 if want else 0):
        got = words[at : at + len(want)]
        last = got[-1].startswith(want[-1]) if phrase.prefix else got[-1] == want[-1]
        if got[:-1] == want[:-1] and last and (not phrase.first or at == 0):
            out.append(at)
    return out


def fits(node, words):
    if isinstance(node, qt.Phrase):
        return bool(starts(node, words))
    if isinstance(node, qt.Near):
        size = lambda p: sum(len(qt.words(t)) for t in p.texts)
        return any(all(any(x <= y and y - x - size(p) <= node.within for y in starts(q, words)) for q in node.phrases if q != p) for p in node.phrases for x in starts(p, words))
    if isinstance(node, qt.But):
        return fits(node.keep, words) and not fits(node.without, words)
    if isinstance(node, qt.Either):
        return any(fits(p, words) for p in node.parts)
    parts = [p for p in node.parts if not (node.tight and isinstance(p, qt.Phrase) and not any(qt.words(t) for t in p.texts))]
    return bool(parts) and all(fits(p, words) for p in parts)


QUERIES = [
    "red fish", '"red fish"', "red + fish", "fish*", '"red fi"*', "^red", "^ the + red", "NEAR(red fish, 0)", "NEAR(fish river)", "NEAR(red fish river, 3)", "NEAR(red red)", "red NOT fish", "red OR whale", "red AND NOT fish", "red river OR blue whale", "(red OR blue) fish NOT river", "blue NOT fish NOT whale",
    "BR-2505", "FA-2025-0411", '"unclosed', "red AND", "NEAR(red", "(red", "red)", "what: is, this? fish!", '"" fish', '"!!" AND fish', "the", "THE FISH", "NOTHING", "AND", "2505*", "f*", "zzz OR fish", "zzz", '"the ""red"" fish"', "red,fish", "near", "NEAR", "a NOT (b OR fish)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_query_equals_a_row_by_row_evaluator(index, query):
    node = qt.read(query)
    want = sorted(i for i, t in TEXTS.items() if fits(node, qt.words(t or "")))
    assert sorted(r["doc"] for r in index.search(query).collect()) == want


@pytest.mark.parametrize("query, tree", [
    ("a b OR c AND d NOT e", qt.Either((qt.Both((qt.Phrase(("a",)), qt.Phrase(("b",))), tight=True), qt.Both((qt.Phrase(("c",)), qt.But(qt.Phrase(("d",)), qt.Phrase(("e",)))))))),
    ('^"x ""y"""*', qt.Phrase(('x "y"',), prefix=True, first=True)), ("NEAR(a b + c, 2)", qt.Near((qt.Phrase(("a",)), qt.Phrase(("b", "c"))), 2)), ("a-b", None), ("a:b", None), ("OR", None), ("", None), ("NEAR(a b, x)", None), ("a +", None), ("()", None),
])
def test_parse(query, tree):
    if tree is None:
        with pytest.raises(qt.Malformed):
            qt.parse(query)
    else:
        assert qt.parse(query) == tree


def test_nothing_to_search_for(index):
    with pytest.raises(qt.Malformed):
        index.search("  ")
    assert index.search('"..."').count() == 0


@pytest.mark.parametrize("terms", [["fish"], ["red", "fish"], ["the"], ["nowhere"]])
def test_scores_equal_the_scan(index, docs, terms):
    want = {r["doc"]: round(r["score"], 9) for r in ft.search(docs, "id", "text", terms).collect()}
    assert {r["doc"]: round(r["score"], 9) for r in index.search(" ".join(terms)).collect()} == want


@pytest.mark.parametrize("lane, query, terms", [("trigram", "プロジ", ["プロジ"]), ("trigram", "プロジェ", ["プロジ", "ロジェ"]), ("bigram", "会議", ["会議"])])
def test_lanes_of_characters(index, docs, lane, query, terms):
    from cairn.functions import text as tx

    own = docs.where(tx.has_unsegmented(F.col("text")))
    want = {r["doc"] for r in ft.search(own, "id", "text", terms, lane).collect()}
    assert want and {r["doc"] for r in index.search(query, lane).collect()} == want
    if len(terms) == 1:
        assert {r["doc"]: round(r["score"], 9) for r in index.search(query, lane).collect()} == {r["doc"]: round(r["score"], 9) for r in ft.search(own, "id", "text", terms, lane).collect()}


def test_merged_lanes(index):
    got = {r["doc"]: r["score"] for r in index.merged({"word": "fish", "trigram": "プロジェ", "bigram": "会議"}).collect()}
    parts = [(ft.LANES[lane], {r["doc"]: r["score"] for r in index.search(q, lane).collect()}) for lane, q in (("word", "fish"), ("trigram", "プロジェ"), ("bigram", "会議"))]
    assert got == {d: max(w * s[d] for w, s in parts if d in s) for _, s1 in parts for d in s1}


def test_only_the_folders_of_a_term_are_read(spark, store, index):
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    one = plan(index.rows(["fish"], [], "word"))
    assert "EqualTo(term,fish)" in one and all(regex.search(r"PartitionFilters: \[[^\]]*" + c, one) for c in ("lane", "bucket"))
    assert not regex.search(r"PartitionFilters: \[[^\]]*bucket", plan(index.rows([], ["f"], "word")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = index.rows(["fish"], [], "word")
        read.collect()
        leaves = read._jdf.queryExecution().executedPlan().collectLeaves()
        files = sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    every = len(store.files(f"{store.root}/data/postings"))
    assert 0 < files <= 2 < every


def test_remove_and_old_versions(spark, store, docs):
    before = store.numbers()[-1]
    ix.remove(store, spark.createDataFrame([(1,), (4,)], "doc int"))
    now, then = ix.Index(store), ix.Index(store, before)
    assert sorted(r["doc"] for r in now.search("swims").collect()) == [14]
    assert sorted(r["doc"] for r in then.search("swims").collect()) == [1, 14]
    store.restore(before)


def test_empty_table(spark, docs):
    store = Store(spark, "file://" + tempfile.mkdtemp(prefix="cairn-index-"))
    ix.write(store, docs.where("false"), "id", "text")
    assert ix.Index(store).search("fish").count() == 0
    ix.write(store, docs, "id", "text", append=True)
    assert ix.Index(store).search("fish").count() == 6


# ---- builds and removals in parts


def shuffled(spark):
    """Shuffle files on this machine."""
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for root in at for _, _, names in os.walk(root) for name in names if name.startswith("shuffle_")}


@pytest.fixture
def table(spark, docs, tmp_path):
    docs.drop("bucket").write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_parts_are_one_index(spark, table, tmp_path, monkeypatch):
    """A small PART cuts this table into as many parts as there may be, some of them without a term."""
    def made(name):
        store = Store(spark, f"file://{tmp_path}/{name}")
        ix.write(store, table, "id", "text", buckets=8)
        told = [(len(store.version().tables["postings"]["folders"]), sorted(map(tuple, store.read("stats").collect())))]
        for gone in ("id IN (1, 4, 9)", "id < 99"):
            ix.remove(store, table.where(gone).select(F.col("id").alias("doc")))
            told.append((len(store.version().tables["postings"]["folders"]), sorted(map(tuple, store.read("stats").collect()))))
        return told, [sorted(map(str, store.read("postings", n).collect())) for n in store.numbers()]

    one, rows = made("one")
    monkeypatch.setattr(ix, "PART", 1)
    parts, cut = made("parts")
    assert cut == rows and [len(r) > 0 for r in rows] == [True, True, False]
    assert [p[1] for p in parts] == [p[1] for p in one] and [p[0] for p in one] == [1, 1, 1]
    assert [p[0] for p in parts] == [ix.TEXT_PARTS, ix.BUCKET_PARTS, ix.BUCKET_PARTS]
    # without 1, 4 and 9 it is the index of the rest, but for the documents without terms, which aren't known
    rest = Store(spark, f"file://{tmp_path}/rest")
    ix.write(rest, table.where("id NOT IN (1, 9)"), "id", "text", buckets=8)
    assert sorted(map(str, rest.read("postings").collect())) == cut[1] and sorted(map(tuple, rest.read("stats").collect())) == parts[1][1]


def test_what_a_part_shuffles_is_gone_before_the_next(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "PART", 1, raising=False)
    store, seen, write = Store(spark, f"file://{tmp_path}/index"), [], Store._write
    before = shuffled(spark)
    monkeypatch.setattr(Store, "_write", lambda self, name, *a: (write(self, name, *a), seen.append((name, len(shuffled(spark) - before))))[0])
    ix.write(store, table, "id", "text", buckets=8)
    ix.remove(store, table.where("id > 5").select(F.col("id").alias("doc")))
    assert [n for name, n in seen if name == "postings"] == [0, 0]


def test_documents_without_a_term(spark, table, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    ix.write(store, table.where("id IN (4, 5)"), "id", "text")
    assert sorted(map(tuple, store.read("stats").collect())) == [("bigram", 0, 0), ("trigram", 0, 0), ("word", 2, 0)]
    assert ix.Index(store).search("fish").count() == 0
