"""Groups of spelling variants by full neighbourhood generation.

The vocabulary is what occurs often enough in the texts. For each word all distinct strings
at one deletion, replacement or insertion over the observed alphabet are made, and joined
by hash with the vocabulary: what meets is near, without any distance being worked out.
A word's form is its commonest near word, if that is commoner by a factor; following the
forms leads to the root of a group.

A word of 9 letters has some 900 neighbours, nearly all of them no words. They are made
as sums of hashes, in numpy, and held against a filter of the vocabulary before they become
strings: a table of at most ``SLOTS`` 64-bit words (16 MB, the only thing that is broadcast,
however many words there are). The filter has no false negatives, and what it lets through
wrongly finds no partner in the join, so it changes the cost and no row. With ``SLOTS`` all
in use at 8 million words about one neighbour in 300 passes wrongly; with more words more do.
A long word's neighbours are made in blocks of positions, in bounded memory.

Words are counted in two steps (partial counts, then one exchange), so a word that is a third
of all words is no burden to one task. A word has no more near words than neighbours. Each
step of the roots is a join with a table that has each word once.

Null texts have no words; a null id counts as an empty string; repeated rows count each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F

from cairn.plans.durable import Scratch

RUNS = r"[A-Za-zÀ-ÿ]+"
#: Of so many runs of letters one loses a letter.
TYPO_EVERY = 199
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
SLOTS = 1 << 21
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Neighbours that are worked out at once.
_BLOCK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, run)``: the maximal runs of letters of whole texts, A-Z in lower case."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), 0)).alias("run")).select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))


def with_typos(found: DataFrame, every: int = TYPO_EVERY) -> DataFrame:
    """``(word)``: each run, less one letter where the hash of its document and itself says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"), "utf-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and common enough."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_letters(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _STEP
    return np.multiply.accumulate(out, dtype=np.uint64)


def _matrices(words: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of one length at a time, also as a matrix of code points."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        own = words.filter(pa.array(lengths == n)).to_pylist()
        rows = max(1, (_BLOCK * 4) // int(n))
        for at in range(0, len(own), rows):
            part = own[at : at + rows]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), int(n))


def _sums(codes: np.ndarray) -> np.ndarray:
    """Sums of the letters' hashes before each position, by row: column i has those of the first i letters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(_of_letters(codes) * _powers(codes.shape[1])[None, :], axis=1, out=out[:, 1:])
    return out


def _slot(sums: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a string's bits are in a filter, and which: four of one word."""
    h = _mixed(sums)
    mask = np.zeros(h.shape, np.uint64)
    for s in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(s)) & np.uint64(63))
    return (h >> np.uint64(24)) % np.uint64(slots), mask


def vocabulary_filter(words: DataFrame, count: int, most: int = SLOTS) -> np.ndarray:
    """A table of bits in which each word's are set: 16 bits a word, ``most`` 64-bit words at most."""
    slots = min(most, 1 << max(6, (count // 4).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in _matrices(b.column("word")):
                slot, mask = _slot(_sums(codes)[:, -1], slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    # one row per slot at most, whatever the number of words
    found = words.select("word").mapInArrow(run, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(slots, np.uint64)
    out[found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def _neighbours(codes: np.ndarray, letters: np.ndarray, shortest: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Kind, first position, hash sums and which of them count, in blocks: rows, positions, and letters but for deletions.

    Each neighbour counts once: of equal letters in a row the first is deleted, and a letter
    isn't inserted behind its like.
    """
    n, size = codes.shape
    before, powers, own = _sums(codes), _powers(size + 2), _of_letters(letters)
    total = before[:, -1:]
    step = max(1, _BLOCK // max(1, n * max(1, len(letters))))
    for at in range(0, size, step):
        to = min(size, at + step)
        if size - 1 >= shortest:
            first = np.ones((n, to - at), bool)
            first[:, (at == 0) :] = codes[:, max(at, 1) : to] != codes[:, max(at, 1) - 1 : to - 1]
            yield "delete", at, before[:, at:to] + (total - before[:, at + 1 : to + 1]) * _BACK, first
        if size >= shortest:
            gone = total - _of_letters(codes[:, at:to]) * powers[at:to]
            yield "replace", at, gone[:, :, None] + powers[at:to][None, :, None] * own[None, None, :], codes[:, at:to, None] != letters[None, None, :]
    for at in range(0, size + 1, step):
        to = min(size + 1, at + step)
        other = np.ones((n, to - at, len(letters)), bool)
        other[:, (at == 0) :] = codes[:, max(at, 1) - 1 : to - 1, None] != letters[None, None, :]
        yield "insert", at, (before[:, at:to] + (total - before[:, at:to]) * _STEP)[:, :, None] + powers[at:to][None, :, None] * own[None, None, :], other


def neighbours(words: DataFrame, letters: str, known, shortest: int = MIN_LENGTH) -> DataFrame:
    """``(word, near)``: each word's distinct neighbours of ``shortest`` letters or more that the filter ``known`` (a broadcast, or None for all) lets through."""
    points = np.array(sorted(map(ord, letters)), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if known is None else known.value
        for b in batches:
            for part, codes in _matrices(b.column("word")):
                rows = max(1, _BLOCK // (codes.shape[1] * max(1, len(points))))
                for k in range(0, len(part), rows):
                    for kind, at, sums, counts in _neighbours(codes[k : k + rows], points, shortest):
                        if table is None:
                            hit = counts
                        else:
                            slot, mask = _slot(sums, len(table))
                            hit = counts & ((table[slot] & mask) == mask)
                        where = np.nonzero(hit)
                        source = [part[k + r] for r in where[0].tolist()]
                        spots = (where[1] + at).tolist()
                        if kind == "delete":
                            made = [w[:i] + w[i + 1 :] for w, i in zip(source, spots, strict=True)]
                        else:
                            skip = kind == "replace"
                            made = [w[:i] + c + w[i + skip :] for w, i, c in zip(source, spots, map(chr, points[where[2]].tolist()), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(made, pa.string())], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def near_words(words: DataFrame, scratch: Scratch, count: int, shortest: int = MIN_LENGTH) -> DataFrame:
    """``(word, near, near_n)``: all pairs of words at one edit, from both ends. words: ``(word, n)``, written, each word once."""
    spark = words.sparkSession
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]))  # the letters of the class at most
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 20_000)  # a word is some hundred neighbours' work
    spread = words.select("word").repartition(tasks, "word")
    known = spark.sparkContext.broadcast(vocabulary_filter(words, count))
    made = neighbours(spread, letters, known, shortest)
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``(word, n, n_near, form, form_n)``: a word's commonest near word (the first in code-point order of equally common ones), if it is ``factor`` times as common."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    counts = F.coalesce("n_near", F.lit(0)).cast("bigint")
    wins = -F.col("best.less") >= factor * F.col("n")
    return words.join(best, "word", "left").select("word", "n", counts.alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of the words that have a form. A form is ``factor`` times as common as its word, so no way is longer than the logarithm of the largest count."""
    links = scratch.keep(found.where("form is not null").select("word", "form"), "links")
    at, done = links.select("word", F.col("form").alias("root")), []
    while True:
        seen = Observation()
        step = at.join(links.select(F.col("word").alias("root"), "form"), "root", "left").select("word", "root", "form")
        step = scratch.keep(step.observe(seen, F.count("form").alias("more")), "roots")
        done.append(step.where("form is null").select("word", "root"))
        if not seen.get["more"]:
            break
        at = step.where("form is not null").select("word", F.col("form").alias("root"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def group_variants(words: DataFrame, scratch: Scratch, shortest: int = MIN_LENGTH, factor: int = FACTOR) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of a vocabulary ``(word, n)`` that has each word once."""
    words = scratch.keep(words, "words")
    found = scratch.keep(forms(words, near_words(words, scratch, words.count(), shortest), factor), "forms")
    return found.join(roots(found, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of whole ``documents``, some of which have lost a letter."""
    return group_variants(vocabulary(with_typos(runs(docs))), Scratch(docs.sparkSession, "spelling"))


SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(crc ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
    FROM range(256) t(b))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, [4294967295] || flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END)) AS b
  FROM counted
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1]))) AS h FROM bytes, polynomial
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), less AS (
  SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS part FROM cuts
), holes AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part FROM cuts
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w USING (word) JOIN formed r ON r.word = w.root AND r.form IS NULL
"""
