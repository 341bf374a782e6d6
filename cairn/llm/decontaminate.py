"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: letters, digits and
everything outside ASCII. A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window. Windows go into one automaton as normalised
text (words with one space around each), and a document's normalised text passes
through it once. What is hit maps back to word positions, and from there to offsets in
the original text.

A word of a document is hit if it lies in any occurrence of a window. A document is
contaminated if ``n_hit > 0`` and ``n_hit >= share * n_words``, in whole numbers.

The automaton is built once from the benchmark, on the driver, and sent to the tasks. Its
size is checked first: a benchmark of more than ``max_chars`` characters of windows is
dealt into lots, and the documents pass the automaton of one lot after the other, each
pass written before the next. So no task ever holds more than one automaton of that size,
and the result is that of a single one.

Null text has no words. A benchmark row without an ``item_id`` or without a text is no item;
ids may be of any type that has an order. Items with equal windows all count. Repeated
document rows get equal results. Extra columns are ignored unless carried; a carried column
may have the name of one of the operator's own only inside a struct. An empty benchmark
hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from cairn.llm.batches import map_texts
from cairn.plans.durable import Scratch

_UPPER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    """A-Z in lower case; no character changes its place."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def windows(text: str | None, window: int = 13) -> list[str]:
    """The normalised windows of an item, each with a space before and after."""
    ws = WORD.findall(lower(text)) if text else []
    return [f" {' '.join(ws[i : i + window])} " for i in range(max(1, len(ws) - window + 1))] if ws else []


class Automaton:
    """Finds the windows of items in a text, with places."""

    def __init__(self, items: dict[str, list]):
        """items: for each window, the ids that have it. Windows are numbered."""
        self.ids = [items[w] for w in sorted(items)]
        self.machine = ahocorasick.Automaton()
        for k, w in enumerate(sorted(items)):
            self.machine.add_word(w, (k, w.count(" ") - 1))
        self.machine.make_automaton()

    def find(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """``(words, merged spans of hit words as [first, last), ids of items hit)``."""
        ws = WORD.findall(text)
        spans: list[tuple[int, int]] = []
        ids: set = set()
        if ws and len(self.machine):
            norm = f" {' '.join(ws)} "
            starts = None
            for end, (k, n) in self.machine.iter(norm):
                if starts is None:  # few texts have a hit: words are only counted then
                    starts = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
                last = int(np.searchsorted(starts, end))  # the space at `end` follows word last - 1
                spans.append((last - n, last))
                ids.update(self.ids[k])
        return len(ws), merged(spans), ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def lots(benchmark: DataFrame, window: int = 13, max_chars: int = 16_000_000) -> Iterator[dict[str, list]]:
    """The windows of all items with the ids that have them, in lots of at most ``max_chars`` characters; one empty lot if there is none.

    All items of a window are in its lot: lots are ranges of the windows' hash.
    """
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = sum(len(w) for r in rows.toLocalIterator() for w in set(windows(r["text"], window)))  # a benchmark, not a corpus; one partition at a time
    count = max(1, -(-size // max_chars))
    for k in range(count):
        items: dict[str, list] = {}
        for r in rows.toLocalIterator():
            for w in set(windows(r["text"], window)):
                if count == 1 or int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % count == k:
                    items.setdefault(w, []).append(r["item_id"])
        yield items


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, item_ids array<{id}>, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
_SO_FAR = "words bigint, hit array<struct<first:bigint,last:bigint>>, ids array<{id}>"


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, carry: tuple[str, ...] = ("doc_id",), max_chars: int = 16_000_000) -> DataFrame:
    """The columns of ``carry`` and SCHEMA: counts, the item ids (sorted as strings) and the hit spans as code-point offsets of the original text."""
    spark, least = docs.sparkSession, Fraction(str(share))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    parts = lots(benchmark, window, max_chars)
    items, more = next(parts), next(parts, None)
    if more is None:
        sent = spark.sparkContext.broadcast(Automaton(items))

        def make():
            return lambda texts: _columns([_judge(t, *sent.value.find(lower(t) if t else ""), least) for t in texts], 7)

        return map_texts(docs, "text", list(carry), SCHEMA.format(id=kind), make)
    scratch = Scratch(spark, "decontaminate")
    rows = docs.select(F.struct(*carry).alias("carried"), "text")
    n = 0
    while items is not None:
        k, n = n, n + 1
        one = spark.sparkContext.broadcast(Automaton(items))
        rows = scratch.keep(map_texts(rows, "text", [c for c in rows.columns], _SO_FAR.format(id=kind).replace("words", f"words{k}").replace("hit ", f"hit{k} ").replace("ids ", f"ids{k} "), _finder(one)), "lot")
        one.destroy()
        items, more = more, next(parts, None)
    seen = rows.select("carried.*", F.struct("text", F.col("words0").alias("words"), F.flatten(F.array(*[f"hit{k}" for k in range(n)])).alias("hit"), F.array_distinct(F.flatten(F.array(*[f"ids{k}" for k in range(n)]))).alias("ids")).alias("seen"))

    def judge():
        def of(rows: list) -> list:
            return _columns([_judge(r["text"], r["words"], merged([(h["first"], h["last"]) for h in r["hit"]]), set(r["ids"]), least) for r in rows], 7)

        return of

    return map_texts(seen, "seen", list(carry), SCHEMA.format(id=kind), judge)


def _columns(rows: list[tuple], n: int) -> list:
    return list(zip(*rows, strict=True)) or [[]] * n


def _finder(sent):
    def make():
        def find(texts: list) -> list:
            found = [sent.value.find(lower(t) if t else "") for t in texts]
            return _columns([(n, [{"first": a, "last": b} for a, b in spans], sorted(ids, key=str)) for n, spans, ids in found], 3)

        return find

    return make


def _judge(text: str | None, n: int, spans: list[tuple[int, int]], ids: set, least: Fraction) -> tuple:
    hits = sum(b - a for a, b in spans)
    places = []
    if spans:
        at = [m.span() for m in WORD.finditer(lower(text))]
        places = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]
    names = sorted(ids, key=str)
    return n, hits, len(names), names, hashlib.sha256(",".join(map(str, names)).encode()).hexdigest(), hits > 0 and least.denominator * hits >= least.numerator * n, places


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pats AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM pats),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
grams AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
occ AS (SELECT g.r, g.i, g.n, p.item_id FROM grams g JOIN pats p ON p.n = g.n AND p.w = g.w),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM occ) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit h ON h.r = d.r LEFT JOIN ids i ON i.r = d.r
"""
