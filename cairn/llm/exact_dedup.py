"""Exact duplicates by a tree merge of sorted digest runs (DataFrame operations only).

Documents are dealt into runs of bounded size. A run keeps one entry per digest: the
best row and the number of rows. In each round ``fan_in`` runs of the tree merge into
one, keeping the best of the entries with the same digest, until one run is left; then
the winners are handed down the same tree, so that a group that holds a third of all
rows never meets in one task: each level joins at most ``fan_in`` entries of a digest,
and the leaves at most one run's rows. A run is spread over the shuffle partitions by
its digest, so that the last run, which has all digests, isn't in one place either.

Digests are verified at each level: entries are one group only if SHA-256, a second
64-bit hash and the length of the normalised text are all equal.

Null text counts as empty, and all empty texts are one group. A null ``doc_id`` sorts
last. Repeated rows are rows of their own: they count, and one of them stays. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.plans.durable import Scratch

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
_KEY = ["sha", "xx", "n"]


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: what the merge needs and no text."""
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
        .select("doc_id", F.length("t").alias("len"), normalised(F.col("t")).alias("norm"))
        .select("doc_id", "len", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("xx"), F.length("norm").alias("n"), F.monotonically_increasing_id().alias("row"))
    )


def exact_dedup(docs: DataFrame, run_rows: int = 1 << 14, fan_in: int = 8) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.keep(digests(docs), "digests")
    count, levels = rows.count(), 1
    while run_rows * fan_in**levels < count:
        levels += 1
    runs = fan_in**levels
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)))
    best = F.struct((-F.col("len")).alias("neg_len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("rows"))
    tree = [scratch.keep(level, "run")]
    for _ in range(levels):
        merged = tree[-1].groupBy(F.expr(f"run div {fan_in}").alias("run"), *_KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
        tree.append(scratch.keep(merged, "merge"))
    won = tree.pop()
    while tree:
        below = tree.pop().select("run", F.expr(f"run div {fan_in}").alias("up"), *_KEY)
        won = below.join(won.withColumnRenamed("run", "up"), ["up", *_KEY]).drop("up")
    return rows.join(won, ["run", *_KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
