"""A stored inverted index: postings with positions, in folders by lane and bucket, and a search over them.

A row is one term of one document in one lane, with the places where it stands. A term's bucket
is a hash of its first two characters, so a term or a prefix of two characters or more is in
one folder for each lane; within a file rows are in order of the term, so a search for a term reads
the row groups that can hold it. A folder with too much for one task is spread over several
(Spark rebalances by the sizes it has measured), so a word of all documents is no burden.

Texts are cut into terms once, in generated code; a document's terms are then grouped within its
row, a bounded number of terms at a time, so one exchange of postings is all that is shuffled beside the texts
themselves, which are dealt out to all cores first. A large table's texts are read and indexed in a few
parts, and a large index's buckets rewritten in a few, one after the other, so no more than a
part's rows is ever shuffled at once. Each build, and each append, is one
version of a ``Store``: readers see all of it or none. Statistics are rows of the same version.

A search reads the postings of its terms, groups them by document, and works phrases, nearness
and the query's AND, OR and NOT out as column expressions over positions. Scores are BM25 over
all documents of the lane. What it sends to the driver are counts, one for each phrase.

A null text has no terms but counts as a document. A document that is appended again counts
twice: remove it first (``remove``). An empty table is an index without postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Observation, functions as F

from cairn.functions import querytext as qt, text as tx
from cairn.operators import fulltext as ft
from cairn.operators.relational import SHARE, bytes_of, spread
from cairn.plans.durable import setting
from cairn.sources.versions import Store

BUCKETS = 64
KEY = 2
#: Rows that reach a Python worker at once, and terms that it groups at once (or one document's, if these are more).
ROWS, TERMS = 500, 1 << 18
#: Bytes of files for which a job is done in one more part, and parts at most: each part of a build reads all texts again, one of a removal only its buckets.
PART, TEXT_PARTS, BUCKET_PARTS = 64 << 20, 4, 8
POSTINGS, STATS = "postings", "stats"
#: While it is written, a plan without postings stays as it is: what is counted on the way would go with it.
_COUNTED = ("spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, KEY)), F.lit(buckets)).cast("int")


def _of_words(terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.ListArray]:
    """Terms, their rows, those rows' numbers of terms, and positions, of lists of words: one entry for each term of a row."""
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    flat = terms.flatten().dictionary_encode()
    codes, owner = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order, starts = _runs(owner * max(1, len(flat.dictionary)) + codes)
    which = order[starts]
    return flat.dictionary.take(pa.array(codes[which])), owner[which], sizes[owner[which]], _lists(starts, place[order])


def _of_characters(texts: list[str | None], size: int) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.ListArray]:
    """The same of all runs of ``size`` characters of each text."""
    terms, owner, counts, bounds, places, at = [], [], [], [], [], 0
    for row, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points) - size + 1
        if n < 1:
            continue
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = (key << np.uint64(21)) | points[k : k + n]
        order, starts = _runs(key)
        terms += [text[i : i + size] for i in order[starts].tolist()]
        owner.append(np.full(len(starts), row))
        counts.append(np.full(len(starts), n))
        bounds.append(starts + at)
        places.append(order)
        at += n
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.array(terms, pa.string()), join(owner), join(counts), _lists(join(bounds), join(places))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, each in order of place, and where a key's run begins."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    return order, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(order) else np.zeros(0, np.int64)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _parts(rows: pa.RecordBatch, most: int = TERMS) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many terms, or of one row that has more."""
    total = np.cumsum(rows.column("n").to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < rows.num_rows:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield rows.slice(start, end - start)
        start = end


def _grouped(rows: DataFrame) -> DataFrame:
    """(lane, doc, words, chars, n) as (lane, term, doc, dl, positions): one row for each term of a document."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in _parts(whole)):
            for lane in pc.unique(part.column("lane")).to_pylist():
                b = part.filter(pc.equal(part.column("lane"), lane))
                terms, owner, dl, positions = _of_words(b.column("words")) if lane == "word" else _of_characters(b.column("chars").to_pylist(), ft.SIZE[lane])
                yield pa.RecordBatch.from_arrays([pa.array([lane] * len(terms), pa.string()), terms, b.column("doc").take(pa.array(owner)), pa.array(dl.astype(np.int32)), positions], names=["lane", "term", "doc", "dl", "positions"])

    return rows.select("lane", "doc", "words", "chars", "n").mapInArrow(run, f"lane string, term string, doc {kind}, dl int, positions array<int>")


def _parts_for(size: int, most: int) -> int:
    """One for a frame of unknown size, which might be dear to make again."""
    return max(1, min(-(-size // PART), most)) if size < 1 << 62 else 1


def _texts(docs: DataFrame, doc: str, text: str, lanes: tuple[str, ...], share: int = SHARE) -> DataFrame:
    """(lane, doc, words, chars, n): a text's words, or its characters, and how many terms these make; the lanes of characters hold only documents with scripts that don't separate words."""
    rows = spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), share)
    rows = rows.select("doc", "text", tx.has_unsegmented(F.col("text")).alias("wide")) if lanes != ("word",) else rows

    def own(lane: str) -> Column:
        if lane == "word":
            return F.struct(F.lit(lane).alias("lane"), tx.tokens(F.col("text")).alias("words"), F.lit(None).cast("string").alias("chars"))
        return F.when(F.col("wide"), F.struct(F.lit(lane).alias("lane"), F.lit(None).cast("array<string>").alias("words"), ft.characters(F.col("text"), lane).alias("chars")))

    each = rows.select("doc", F.explode(F.array_compact(F.array(*map(own, lanes)))).alias("t")).select("t.lane", "doc", "t.words", "t.chars")
    size = reduce(lambda a, b: F.when(F.col("lane") == b, F.greatest(F.coalesce(F.length("chars"), F.lit(0)) - ft.SIZE[b] + 1, F.lit(0))).otherwise(a), ft.SIZE, F.coalesce(F.array_size("words"), F.lit(0)))
    return each.withColumn("n", size)


def rows_of(docs: DataFrame, doc: str, text: str, lanes: tuple[str, ...] = tuple(ft.LANES), buckets: int = BUCKETS, seen: Observation | None = None, share: int = SHARE) -> DataFrame:
    """``(term, doc, dl, positions, lane, bucket)`` of all documents, each folder's rows together and in order. seen: counts documents and terms of each lane on the way."""
    texts = _texts(docs, doc, text, lanes, share)
    if seen is not None:
        own = lambda lane: F.col("lane") == lane
        texts = texts.observe(seen, *[F.count_if(own(x)).alias(f"docs_{x}") for x in lanes], *[F.sum(F.when(own(x), F.col("n"))).alias(f"length_{x}") for x in lanes])
    return _foldered(_grouped(texts).withColumn("bucket", bucket(F.col("term"), buckets)))


def _foldered(rows: DataFrame) -> DataFrame:
    """Postings as they are written: each folder's together and in order."""
    return rows.hint("rebalance", F.col("lane"), F.col("bucket")).sortWithinPartitions("lane", "bucket", "term", "doc").select("term", "doc", "dl", "positions", "lane", "bucket")


def write(store: Store, docs: DataFrame, doc: str, text: str, append: bool = False, lanes: tuple[str, ...] = tuple(ft.LANES), buckets: int = BUCKETS) -> int:
    """Index ``docs``, in place of what the store has or behind it; the new version's number."""
    n = _parts_for(bytes_of(docs), TEXT_PARTS)
    parts = [docs.where(F.pmod(F.xxhash64(doc), F.lit(n)) == i) for i in range(n)] if n > 1 else [docs]
    seen = [Observation() for _ in parts]

    def stats() -> DataFrame:
        got = Counter()
        for part, own in zip(parts, seen, strict=True):
            got.update({} if part.isEmpty() else {k: int(x or 0) for k, x in own.get.items()})  # a plan without rows may count nothing
        return docs.sparkSession.createDataFrame([(x, got[f"docs_{x}"], got[f"length_{x}"]) for x in lanes], "lane string, docs bigint, length bigint")

    # a part's share of the bytes that Spark takes it to have, which are those of all
    rows = [rows_of(part, doc, text, lanes, buckets, own, n * SHARE) for part, own in zip(parts, seen, strict=True)]
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)), setting(docs.sparkSession, *_COUNTED):
        return store.commit({POSTINGS: rows, STATS: stats}, append=append, partition_by={POSTINGS: ["lane", "bucket"]}, note=f"buckets={buckets}")


def remove(store: Store, docs: DataFrame) -> int:
    """A version without the documents (column ``doc``): postings are rewritten, statistics reduced.

    What is removed is counted on the way: a document's first term stands at 0, and its positions are
    as many as its terms. Older versions hold the documents until the store's next vacuum.
    """
    index = Index(store)
    # read back, so that Spark knows how few the ids may be
    gone = store.scratch.keep(docs.select("doc").distinct(), "gone")
    n = _parts_for(sum(size for folder in store.version().tables[POSTINGS]["folders"] for size in store.files(f"{store.root}/{folder}").values()), BUCKET_PARTS)
    parts = [index.postings.where(F.col("bucket") % n == i) for i in range(n)] if n > 1 else [index.postings]
    lanes, lost = sorted(index.stats), [Observation() for _ in parts]

    def without(rows: DataFrame, seen: Observation) -> DataFrame:
        own = lambda lane: F.col("gone") & (F.col("lane") == lane)
        marked = rows.join(gone.withColumn("gone", F.lit(True)), "doc", "left")
        counted = marked.observe(seen, *[F.count_if(own(x) & (F.get("positions", F.lit(0)) == 0)).alias(f"docs_{x}") for x in lanes], *[F.sum(F.when(own(x), F.size("positions"))).alias(f"length_{x}") for x in lanes])
        return _foldered(counted.where("gone IS NULL"))

    def stats() -> DataFrame:
        got = Counter()
        for part, seen in zip(parts, lost, strict=True):
            got.update({} if part.isEmpty() else {k: int(x or 0) for k, x in seen.get.items()})
        less = store.spark.createDataFrame([(x, -got[f"docs_{x}"], -got[f"length_{x}"]) for x in lanes], "lane string, docs bigint, length bigint")
        return store.read(STATS).unionByName(less).groupBy("lane").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))

    with setting(store.spark, *_COUNTED):
        number = store.commit({POSTINGS: [without(rows, seen) for rows, seen in zip(parts, lost, strict=True)], STATS: stats}, partition_by={POSTINGS: ["lane", "bucket"]}, note=store.version().note)
    store.scratch.drop(gone)
    return number


_STOPWORDS = regex.compile(tx.any_of(tx.RECALL_STOPWORDS))
_UNSEGMENTED = regex.compile("[" + regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), tx.UNSEGMENTED) + "]")


def terms_in(text: str, lane: str) -> list[str]:
    """A query's text as terms of a lane, as documents are cut."""
    if lane == "word":
        return qt.words(text)
    bare = _STOPWORDS.sub(" ", text)
    chars = bare.lower() if lane == "trigram" else "".join(_UNSEGMENTED.findall(bare))
    return [chars[i : i + ft.SIZE[lane]] for i in range(len(chars) - ft.SIZE[lane] + 1)]


class Index:
    """A version of a stored index, opened for searching."""

    def __init__(self, store: Store, number: int | None = None):
        found = store.version(number)
        if found is None:
            raise KeyError(store.root)
        self.postings = store.read(POSTINGS, found.number)
        self.buckets = int(found.note.rpartition("buckets=")[2])
        totals = store.read(STATS, found.number).groupBy("lane").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).collect()  # a row a lane
        self.stats = {r["lane"]: (r["docs"], r["length"] / r["docs"] if r["docs"] else 0.0) for r in totals}
        self._known: dict[str, int] = {}

    def _bucket(self, term: str) -> int:
        """Spark's own hash, asked once for each beginning."""
        head = term[:KEY]
        if head not in self._known:
            spark = self.postings.sparkSession
            self._known[head] = spark.range(1).select(bucket(F.lit(head), self.buckets)).first()[0]
        return self._known[head]

    def rows(self, terms: list[str], prefixes: list[str], lane: str) -> DataFrame:
        """Postings of terms, and of all terms with a prefix: folders and row groups that can't have one aren't read."""
        heads = [*terms, *prefixes]
        if not heads:
            return self.postings.where("false")
        has = reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in prefixes], F.col("term").isin(terms)) if prefixes else F.col("term").isin(terms)
        own = self.postings.where((F.col("lane") == lane) & has)
        return own if any(len(h) < KEY for h in prefixes) else own.where(F.col("bucket").isin(sorted({self._bucket(h) for h in heads})))

    def search(self, query: str | object, lane: str = "word") -> DataFrame:
        """``(doc, score)`` of the documents that a query fits."""
        node = qt.read(query) if isinstance(query, str) else query
        phrases = list(dict.fromkeys(qt.phrases_of(node)))
        cut = {p: [t for text in p.texts for t in terms_in(text, lane)] for p in phrases}
        exact = list(dict.fromkeys(t for p in phrases for t in (cut[p][:-1] if p.prefix else cut[p])))
        prefixes = list(dict.fromkeys(cut[p][-1] for p in phrases if p.prefix and cut[p]))
        found = self.rows(exact, prefixes, lane).groupBy("doc").agg(
            F.max("dl").alias("dl"),
            *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"t{i}") for i, t in enumerate(exact)],
            *[F.flatten(F.collect_list(F.when(F.col("term").startswith(t), F.col("positions")))).alias(f"p{i}") for i, t in enumerate(prefixes)],
        )
        places = []
        for k, p in enumerate(phrases):
            at = [F.col(f"t{exact.index(t)}") for t in (cut[p][:-1] if p.prefix else cut[p])] + ([F.col(f"p{prefixes.index(cut[p][-1])}")] if p.prefix and cut[p] else [])
            places.append(_starts(at, p.first).alias(f"s{k}"))
        found = found.select("doc", "dl", *places)
        starts = {p: F.col(f"s{k}") for k, p in enumerate(phrases)}
        sizes = {p: len(cut[p]) for p in phrases}
        n, avgdl = self.stats.get(lane, (0, 0.0))
        df = found.agg(*[F.count_if(F.size(f"s{k}") > 0).alias(f"s{k}") for k in range(len(phrases))]).first() if n and (exact or prefixes) else [0] * len(phrases)
        score = reduce(lambda a, b: a + b, [F.when(F.size(f"s{k}") > 0, ft.bm25(F.size(f"s{k}"), F.col("dl"), F.lit(float(n)), F.lit(avgdl), F.lit(float(df[k])))).otherwise(0.0) for k in range(len(phrases))])
        return found.where(_fits(node, starts, sizes)).select("doc", score.alias("score"))

    def merged(self, by_lane: dict[str, str | object]) -> DataFrame:
        """``(doc, score)``: the best weighted score of a document over lanes."""
        own = [self.search(q, lane).select("doc", (F.col("score") * ft.LANES[lane]).alias("score")) for lane, q in by_lane.items()]
        return reduce(DataFrame.unionByName, own).groupBy("doc").agg(F.max("score").alias("score"))


def _starts(at: list[Column], first: bool) -> Column:
    """Where the terms stand one after the other, from their positions; none if there are no terms."""
    none = F.array().cast("array<int>")
    if not at:
        return none
    back = lambda c, k: F.coalesce(c, none) if k == 0 else F.transform(F.coalesce(c, none), lambda x: x - k)
    out = reduce(F.array_intersect, [back(c, k) for k, c in enumerate(at)])
    return F.filter(out, lambda x: x == 0) if first else out


def _fits(node: object, starts: dict, sizes: dict) -> Column:
    """Whether a document fits an expression."""
    if isinstance(node, qt.Phrase):
        return F.size(starts[node]) > 0
    if isinstance(node, qt.Near):
        # some phrase comes first; all others start at most so far behind its end
        def from_(p):
            others = [q for q in node.phrases if q != p]
            ok = lambda x, q: F.exists(starts[q], lambda y: (y >= x) & (y - x - sizes[p] <= node.within))
            return F.exists(starts[p], lambda x: reduce(lambda a, b: a & b, [ok(x, q) for q in others], F.lit(True)))

        return reduce(lambda a, b: a | b, [from_(p) for p in node.phrases])
    if isinstance(node, qt.But):
        return _fits(node.keep, starts, sizes) & ~_fits(node.without, starts, sizes)
    parts = [p for p in node.parts if not (isinstance(node, qt.Both) and node.tight and isinstance(p, qt.Phrase) and not sizes[p])]
    if isinstance(node, qt.Either):
        return reduce(lambda a, b: a | b, [_fits(p, starts, sizes) for p in parts])
    return reduce(lambda a, b: a & b, [_fits(p, starts, sizes) for p in parts]) if parts else F.lit(False)
