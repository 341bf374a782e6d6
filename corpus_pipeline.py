"""From documents to shards of token ids: each stage takes what the one before kept.

1. language: documents in no known language go.
2. near_dedup: of each group of near copies (similarity 0.8 of five-word shingles), the document with the smallest id stays.
3. decontaminate: documents that repeat passages of the benchmark go.
4. mix: sources come to their target weights; sources with too little start further epochs,
   so documents may be repeated, and none is lost.
5. tokens: the training order, as sequences of token ids by slot.

All stages but the last return the columns of ``documents``. A stage's output is written to
the shared folder, and the next one reads it from there: a lost executor repeats tasks of
one stage, never the stages before it. What a stage wrote for itself is deleted when a later
stage starts and nobody holds what the earlier one returned any more (a frame made from it
doesn't count: keep the stage's own). The shards of the last stage are its result and stay.

Nulls, empty and repeated rows: no text or no letter is no language, so such a row goes in stage
1; to the other stages an empty text is a text, and null counts as empty. Repeated rows are near
copies. A null id, source or language is a value like others. Extra columns pass through. An
empty table gives no rows.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import decontaminate, language, mixing, simhash, token_shards
from cairn.plans.durable import Scratch
from cairn.sources.tables import table

#: Below this posterior a language is not believed.
SURE = 0.5


def _whole(docs: DataFrame, *own: str) -> DataFrame:
    """A row's columns as one, ``doc``, beside those that a stage works on: whatever else it has can't clash."""
    return docs.select(*own, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


_SPENT: list[tuple[Scratch, weakref.ref]] = []


def _sweep(docs: DataFrame) -> None:
    """Tables of an earlier stage go once nobody holds what it returned and ``docs`` doesn't read them."""
    read = docs.inputFiles()
    for old, held in list(_SPENT):
        if held() is None and not any(old.root.rsplit("/", 1)[-1] in f for f in read):
            old.discard()
            _SPENT.remove((old, held))


def _until_read(out: DataFrame, scratch: Scratch) -> DataFrame:
    """What a stage returns: as long as somebody holds it, its tables stay."""
    _SPENT.append((scratch, weakref.ref(out)))
    return out


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose language is uncertain."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    seen = language.identify(_whole(docs, "text"), model, ["doc"])
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select("doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies (five words, similarity 0.8), that of the smallest id; repeated rows and rows without an id are copies like any other."""
    _sweep(docs)
    scratch = Scratch(spark, "near-dedup")
    rows, stays = simhash.near_copies(docs, scratch)
    return _until_read(simhash.stay(rows, stays, scratch), scratch)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    _sweep(docs)
    seen = decontaminate.scan_documents(_whole(docs, "text"), table(spark, sf_dir, "benchmark"), carry=("doc",))
    return seen.where(~F.col("contaminated")).select("doc.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of sources that are below their target weight, by whole scheduled blocks."""
    _sweep(docs)
    return mixing.mix_sources(_whole(docs, "doc_id", "source"), carry=["doc"]).select("doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents, by slot of the training order, from the shards as written."""
    _sweep(docs)
    # the shards are the result: they stay
    return token_shards.materialise(token_shards.training_order(docs, carry=["doc_id", "lang", "source"]), Scratch(spark, "token-shards"))


STAGES = [("language", language_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mix", mix_stage), ("tokens", token_stage)]

#: SQL has no classifier, fingerprint or tokenizer like these: the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
