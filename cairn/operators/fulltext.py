"""Full-text search in three lanes: words, character trigrams and bigrams of unsegmented scripts.

An index is a table of postings, one row per lane, term and document. A search over an index
reads the postings of its terms only, by an equality filter on the term. A search without
an index counts terms inside each row, in one pass over the texts, so that nothing is
exploded or shuffled. Both score with BM25 (k1 1.2, b 0.75) and statistics of the
whole table, whatever the scope that is searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cairn.functions import text as tx
from cairn.operators.relational import spread
from cairn.plans.durable import Scratch

K1, B = 1.2, 0.75
LANES = {"word": 1.0, "trigram": 0.85, "bigram": 0.7}


#: Characters of a term in the lanes that aren't made of words.
SIZE = {"trigram": 3, "bigram": 2}


def characters(text: Column, lane: str) -> Column:
    """The characters that a lane's terms are runs of."""
    return F.lower(tx.strip_stopwords(text)) if lane == "trigram" else tx.searched_unsegmented(text)


def terms_of(text: Column, lane: str) -> Column:
    """A text's terms in a lane."""
    return tx.tokens(text) if lane == "word" else tx.ngrams(characters(text, lane), SIZE[lane])


def _searched(text: Column, lane: str) -> Column:
    """What a search reads of a text: its words, or its characters in a row; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return tx.tokens(text) if lane == "word" else characters(text, lane)


def _count(searched: Column, term: str, lane: str) -> Column:
    """How often a term stands there; runs of characters may overlap."""
    return F.size(F.filter(searched, lambda x: x == term)) if lane == "word" else F.when(searched.contains(term), F.regexp_count(searched, F.lit(rf"(?=\Q{term}\E)"))).otherwise(0)


def _length(searched: Column, lane: str) -> Column:
    return F.size(searched) if lane == "word" else F.greatest(F.length(searched) - SIZE[lane] + 1, F.lit(0))


def postings(docs: DataFrame, doc: str, text: str, lanes: tuple[str, ...] = ("word", "trigram", "bigram")) -> DataFrame:
    """``(lane, term, doc, tf, dl)``. The trigram and bigram lanes hold only documents with unsegmented scripts."""
    out = None
    for lane in lanes:
        rows = docs if lane == "word" else docs.where(tx.has_unsegmented(F.col(text)))
        own = rows.select(F.col(doc).alias("doc"), terms_of(F.col(text), lane).alias("terms"))
        own = own.select("doc", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf")).select(F.lit(lane).alias("lane"), "term", "doc", "tf", "dl")
        out = own if out is None else out.unionByName(own)
    return out


def bm25(tf: Column, dl: Column, n: Column, avgdl: Column, df: Column) -> Column:
    """One term's part of a score; frequent terms keep a tiny weight."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(docs: DataFrame, doc: str, text: str, terms: list[str], lane: str = "word") -> DataFrame:
    """``(doc, score)`` of documents that have all terms.

    The texts are read once: counts of the terms in the documents that have them all are
    written, and what is counted over all documents on the way becomes part of the scores.
    """
    dealt = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    counted = dealt.select("doc", _searched(F.col("text"), lane).alias("t"))
    counted = counted.select("doc", _length(F.col("t"), lane).alias("dl"), *[_count(F.col("t"), t, lane).alias(f"tf{i}") for i, t in enumerate(terms)])
    seen = Observation()
    all_docs = counted.observe(seen, F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    has = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    hits, stats = Scratch(docs.sparkSession, "search").keep(all_docs.where(has), "hits"), seen.get
    parts = [bm25(F.col(f"tf{i}"), F.col("dl"), F.lit(stats["n"]), F.lit(stats["avgdl"]), F.lit(stats[f"df{i}"])) for i in range(len(terms))]
    return hits.select("doc", reduce(lambda a, b: a + b, parts).alias("score"))


def search_index(index: DataFrame, n_docs: int, avgdl: float, terms: list[str], lane: str = "word") -> DataFrame:
    """The same over postings: only those of the terms are read."""
    hits = index.where((F.col("lane") == lane) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").withColumn("part", bm25(F.col("tf"), F.col("dl"), F.lit(n_docs), F.lit(avgdl), F.col("df")))
    return scored.groupBy("doc").agg(F.sum("part").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(set(terms))).drop("n")


def phrase(docs: DataFrame, doc: str, text: str, words: list[str]) -> DataFrame:
    """Documents with the words in a row."""
    joined = F.concat(F.lit(" "), F.array_join(tx.tokens(F.col(text)), " "), F.lit(" "))
    return docs.where(joined.contains(" " + " ".join(words) + " ")).select(F.col(doc).alias("doc"))


def prefix(docs: DataFrame, doc: str, text: str, start: str) -> DataFrame:
    """Documents with a word that begins so."""
    return docs.where(F.exists(tx.tokens(F.col(text)), lambda t: t.startswith(start))).select(F.col(doc).alias("doc"))


def merged(docs: DataFrame, doc: str, text: str, by_lane: dict[str, list[str]]) -> DataFrame:
    """Lanes in one ranking: the best weighted score of a document."""
    out = None
    for lane, terms in by_lane.items():
        own = search(docs, doc, text, terms, lane).select("doc", (F.col("score") * LANES[lane]).alias("score"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("doc").agg(F.max("score").alias("score"))
