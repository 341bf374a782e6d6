"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts, per language, the n-grams (1 to 3 characters, over letters in lower case
with a space around each word) of a bounded sample of labelled documents, hashed into
2**bits columns. Tasks count into dense arrays and pass on one row per language that they
saw; the sums meet in a matrix of log-probabilities, of fixed size (languages x 2**bits
floats), which is sent with the scoring tasks, with the logarithm of each language's share
of the sample. A batch of documents is a sparse matrix, documents by hashed n-grams, kept
as the column numbers of each row one after the other; its product with the
log-probabilities is a gather of their rows and one segmented sum. A document that is
longer than a lot of n-grams is summed over several.

The sample is at most ``sample`` documents: all, or those whose hashed id is lowest in
proportion. Sampling bounds only what the model learns from; scoring reads whole texts.

Null text, and text without a letter, is ``und`` with score 0. Documents without a language,
or with a null or empty text, teach nothing. With nothing to learn from, all is ``und``.
Repeated rows get equal results. Extra columns are ignored unless carried. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.batches import map_texts

UNKNOWN = "und"
_CHUNK = 1 << 18


def _letters() -> np.ndarray:
    """For each character of the BMP: itself in lower case if it is a letter, else a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Letters in lower case, runs of anything else as one space, a space at either end; empty if there is no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _TABLE[0][np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        for i in np.flatnonzero(raw > 0xFFFF):
            low[i] = raw[i] if chr(raw[i]).isalpha() else 32
    low = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]])
    space = low == 32
    low = low[~(space & np.concatenate([[False], space[:-1]]))]
    return low if len(low) > 1 else low[:0]


def grams(low: np.ndarray, bits: int, later: bool = False) -> np.ndarray:
    """Hashed n-grams of 1 to 3 characters. later: this is a further piece of a text, and its first two characters were the last two of the piece before."""
    c = low.astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35))
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ (c[2:] * np.uint32(0x165667B1))
    h = np.concatenate([one[1:-1], two[later:] + np.uint32(0x68E31DA4), three + np.uint32(0xB5297A4D)])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


class Model:
    """Languages, their log-probabilities by hashed n-gram, and the logarithms of their shares of documents."""

    def __init__(self, langs: list[str], counts: np.ndarray, bits: int, docs: np.ndarray | None = None):
        self.langs, self.bits = langs, bits
        smooth = counts.astype(np.float64) + 0.5
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)) if langs else np.zeros((1 << bits, 0), np.float32)
        seen = np.ones(len(langs)) if docs is None else docs.astype(np.float64)
        self.prior = np.log(seen / seen.sum()) if langs else np.zeros(0)

    def joint(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The joint log-probability of each text with each language, and each text's number of n-grams."""
        total, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        columns: list[np.ndarray] = []
        rows: list[int] = []
        held = 0

        def add_up() -> None:
            nonlocal held
            if rows:
                starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])[:-1]])
                np.add.at(total, rows, np.add.reduceat(self.logp[np.concatenate(columns)].astype(np.float64), starts, axis=0))
            columns.clear()
            rows.clear()
            held = 0

        for i, text in enumerate(texts):
            low = codes(text) if text else np.zeros(0, np.uint32)
            for at in range(0, len(low) - 2, _CHUNK):
                h = grams(low[at : at + _CHUNK + 2], self.bits, at > 0)
                columns.append(h)
                rows.append(i)
                sizes[i] += len(h)
                held += len(h)
                if held >= _CHUNK:
                    add_up()
        add_up()
        return total + self.prior, sizes

    def score(self, texts: list) -> list:
        """Columns: the language, and its posterior with evidence tempered by the root of the length, as n-grams overlap."""
        if not self.langs:
            return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
        total, sizes = self.joint(texts)
        z = (total - total.max(1, keepdims=True)) / np.maximum(1.0, np.sqrt(sizes))[:, None]
        p = np.exp(z)
        best = total.argmax(1)
        sure = np.where(sizes > 0, p[np.arange(len(texts)), best] / p.sum(1), 0.0)
        return [[self.langs[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)], sure]


def train(docs: DataFrame, label: str = "lang", bits: int = 14, sample: int = 20_000) -> Model:
    """A model from at most about ``sample`` of the documents that have a label and a text."""
    labelled = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    if total > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = codes(text)
                if len(low):
                    docs[lang] = docs.get(lang, 0) + 1
                for at in range(0, len(low) - 2, _CHUNK):
                    own = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                    own += np.bincount(grams(low[at : at + _CHUNK + 2], bits, at > 0), minlength=1 << bits)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            # the number of documents stands as n-gram -1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([*at, -1], pa.int64()), pa.array([*n[at], docs[lang]], pa.int64())], names=["lang", "gram", "n"])

    counted = labelled.select(label, "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most languages x 2**bits rows
    langs = sorted(got["lang"].unique())
    table, docs_of = np.zeros((len(langs), 1 << bits), np.int64), np.zeros(len(langs), np.int64)
    for i, lang in enumerate(langs):
        own = got[(got["lang"] == lang) & (got["gram"] >= 0)]
        table[i, own["gram"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        docs_of[i] = got[(got["lang"] == lang) & (got["gram"] < 0)]["n"].sum()
    return Model(langs, table, bits, docs_of)


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: doc_id), ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**bits floats

    def make():
        return sent.value.score

    return map_texts(docs, "text", carry or ["doc_id"], "lang_pred string, score double", make)


def held_out(doc_id: Column) -> Column:
    """The documents that the registered query and the pipeline don't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``identify`` with a model from the documents that aren't held out."""
    return identify(docs, train(docs.where(~held_out(F.col("doc_id")))), carry)
