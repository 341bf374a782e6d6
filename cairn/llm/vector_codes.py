"""Product codes of vectors: integer Lloyd iterations with Hamerly's bounds.

A vector's components become integers and are cut into equal consecutive parts; each part
has a codebook, and a vector's code is the index of the nearest entry for each part. A row
keeps, for each part, its entry, an upper bound of the distance to that entry and a lower
bound of the distance to the second nearest (Hamerly, "Making k-means even faster", 2010).
When entries move, the bounds move by as much; only where the upper one isn't strictly
below the lower one (or below half the way to the entry's nearest neighbour) are all
entries scanned again. Distances that decide are integers, so ties go to the lower index in
every partitioning; bounds are doubles, widened by more than their rounding errors.

Rows never leave their partition: a pass maps them and writes them back with their new
bounds, so a lost executor repeats tasks of one pass. A codebook is summed up by one row
per entry and task. What is sent to the tasks and to the driver are codebooks, which have
``PARTS * ENTRIES`` entries at most, whatever the table's size.

A vector is dropped if it is null, empty, or holds a null or a component that isn't finite;
also if a component is beyond ``FAR`` (the squares of its distances would leave a 64-bit
integer), or if its length isn't a multiple of ``PARTS`` or isn't that of the kept row with
the smallest id. Null ids come last, repeated ids are rows of their own in order of their
vectors. With fewer rows than entries a codebook has as many entries as rows. Extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.plans.durable import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of at most this size have squared distances, and sums of 64 of them, below 2^63.
FAR = (1 << 27) // SCALE
#: More than the rounding error of one bound, as a share of its terms.
SLACK = 1e-12
#: Integers up to here have products whose sums are exact in doubles (64 components and less than 2^53).
EXACT = 1 << 22
_ROWS = 4096


def quantised(vectors: DataFrame, vector: str, carry: list[str], scale: int = SCALE) -> DataFrame:
    """``carry`` and ``ints``, the floors of the scaled components, of all vectors that aren't dropped by themselves."""
    x_to_int = lambda x: F.when(F.abs(x.cast("double")) < FAR * SCALE / scale, F.floor(x.cast("double") * scale).cast("int"))
    found = vectors.select(*carry, F.transform(vector, x_to_int).alias("ints"))
    return found.where((F.size("ints") > 0) & F.forall("ints", lambda x: x.isNotNull()))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each entry, as exact integers (held in doubles where these are exact)."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None].astype(np.int64) - book[None, :, j]) ** 2
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lower index of equal ones), and the distances to it and to the second nearest."""
    best, near, second = np.zeros(len(x), np.int16), np.zeros(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), _ROWS):
        d = distances(x[at : at + _ROWS], book)
        rows = np.arange(len(d))
        k = d.argmin(1)
        best[at : at + _ROWS], near[at : at + _ROWS] = k, np.sqrt(d[rows, k])
        if len(book) > 1:
            d[rows, k] = d.max() + 1
            second[at : at + _ROWS] = np.sqrt(d.min(1))
    return best, near, second


@dataclass
class Part:
    """A part's codebook, and what its rows' bounds need to know of its last step."""

    book: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self):
        self.half = np.full(len(self.book), np.inf)
        if len(self.book) > 1:
            d = distances(self.book, self.book)
            np.fill_diagonal(d, d.max() + 1)
            self.half = np.sqrt(d.min(1)) / 2 * (1 - SLACK)

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return scan(x, self.book)

    def step(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entries and bounds after the entries moved, and the number of rows that were scanned."""
        top = int(self.moved.argmax())
        rest = np.delete(self.moved, top).max(initial=0.0)
        others = np.where(code == top, rest, self.moved[top])
        own = self.moved[code]
        upper = upper + own + SLACK * (upper + own)
        with np.errstate(invalid="ignore"):
            lower = lower - others - SLACK * (lower + others)
        lower[np.isnan(lower)] = np.inf  # one entry alone
        code = code.copy()
        bound = np.maximum(lower, self.half[code])
        loose = np.flatnonzero(~(upper < bound))
        gap = x[loose].astype(np.int64) - self.book[code[loose]]
        upper[loose] = np.sqrt((gap * gap).sum(1)) * (1 + SLACK)
        fail = loose[~(upper[loose] < bound[loose])]
        code[fail], upper[fail], lower[fail] = scan(x[fail], self.book)
        return code, upper, lower, len(fail)


def _flat(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _assign(rows: DataFrame, parts: list[Part], width: int, carry: list[str]) -> DataFrame:
    """One pass: ``rows`` (carry, ints, and from the second pass on codes, upper, lower) with new codes and bounds, the squared distance, and how many parts were scanned."""
    first, d = "codes" not in rows.columns, width // len(parts)
    names = [*carry, "ints"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", codes array<smallint>, upper array<double>, lower array<double>, error bigint, scanned int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _flat(b, "ints", width), b.num_rows
            codes, upper, lower = np.zeros((n, len(parts)), np.int16), np.zeros((n, len(parts))), np.zeros((n, len(parts)))
            if not first:
                codes, upper, lower = (_flat(b, c, len(parts)).copy() for c in ("codes", "upper", "lower"))
            total, error = np.zeros(n, np.int32), np.zeros(n, np.int64)
            for q, part in enumerate(parts):
                own = np.ascontiguousarray(x[:, q * d : (q + 1) * d])
                if first:
                    codes[:, q], upper[:, q], lower[:, q] = part.start(own)
                    scanned = n
                else:
                    codes[:, q], upper[:, q], lower[:, q], scanned = part.step(own, codes[:, q], upper[:, q], lower[:, q])
                total[:1] += scanned  # counted with the batch's first row
                gap = own.astype(np.int64) - part.book[codes[:, q]]
                error += (gap * gap).sum(1)
            cols = [b.column(c) for c in names] + [_lists(codes, pa.int16()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(error), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "codes", "upper", "lower", "error", "scanned"])

    return rows.select(*names, *([] if first else ["codes", "upper", "lower"])).mapInArrow(run, schema)


def _sums(rows: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """``(part, entry, n, s0, s1, ...)``: how many rows an entry has, and the sums of their components."""
    d = width // len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [np.zeros(k, np.int64) for k in sizes], [np.zeros((k, d), np.int64) for k in sizes]
        for b in batches:
            x, codes = _flat(b, "ints", width), _flat(b, "codes", len(sizes))
            for q, k in enumerate(sizes):
                n[q] += np.bincount(codes[:, q], minlength=k)
                for j in range(d):
                    sums[q][:, j] += np.bincount(codes[:, q], weights=x[:, q * d + j], minlength=k).astype(np.int64)
        for q in range(len(sizes)):
            used = np.flatnonzero(n[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), q, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[q][used]), _lists(sums[q][used], pa.int64())], names=["part", "entry", "n", "sums"])

    partial = rows.select("ints", "codes").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(d)])


@dataclass
class Codes:
    """rows: ``(carry..., ints, codes array<smallint>, error bigint)``; books: entries by part; scanned: parts scanned in each pass."""

    rows: DataFrame
    books: list[np.ndarray]
    scanned: list[int]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, scratch: Scratch, vector: str = "embedding", key: str = "vec_id", carry: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codes of all vectors that are kept, with ``carry`` (by default the key) alongside; None if none is kept.

    A codebook starts as that part of the ``entries`` smallest keys. Each round assigns all parts
    and moves each used entry to the floor of the mean of its parts; in the end all are assigned.
    """
    carry = list(dict.fromkeys(carry if carry is not None else [key]))
    clash = {"ints", "codes", "upper", "lower", "scanned", "error"} & set(carry)
    if clash:
        raise ValueError(f"carried columns with names of the result: {sorted(clash)}")
    if not 1 <= entries <= 256:
        raise ValueError("a code has 1 to 256 entries a part")
    found = quantised(vectors, vector, list(dict.fromkeys([*carry, key])), scale).where(F.size("ints") % parts == 0)
    seeds = found.orderBy(F.col(key).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not seeds:
        return None
    width = len(seeds[0]["ints"])
    found = found.where(F.size("ints") == width)
    if any(len(r["ints"]) != width for r in seeds):
        seeds = found.orderBy(F.col(key).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    start = np.array([r["ints"] for r in seeds], np.int64)
    now = [Part(start[:, q : q + width // parts].copy()) for q in range(0, width, width // parts)]
    rows, scanned = found.select(*carry, "ints"), []
    for turn in range(rounds + 1):
        before, rows = rows, scratch.keep(_assign(rows, now, width, carry), "assigned")
        if turn:
            scratch.drop(before)
        scanned.append(int(rows.agg(F.sum("scanned")).first()[0]))
        if turn < rounds:
            now = _moved(now, _sums(rows, [len(p.book) for p in now], width).collect())
    return Codes(rows.select(*carry, "ints", "codes", "error"), [p.book for p in now], scanned)


def _moved(parts: list[Part], sums: list) -> list[Part]:
    books = [p.book.copy() for p in parts]
    for r in sums:
        for j in range(books[0].shape[1]):
            books[r["part"]][r["entry"], j] = int(r[f"s{j}"]) // r["n"]
    out = []
    for p, book in zip(parts, books, strict=True):
        gap = book - p.book
        out.append(Part(book, np.sqrt((gap * gap).sum(1)) * (1 + SLACK)))
    return out


def compress(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of the table ``embeddings``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    found = encode(vectors, scratch, carry=["vec_id", "label"])
    if found is None:
        none = "vec_id {}, code string, error bigint, label_error bigint, codebooks_sha256 string".format(vectors.schema["vec_id"].dataType.simpleString())
        return spark.createDataFrame([], none)
    code = F.lower(F.concat(*[F.lpad(F.hex(F.col("codes")[q].cast("bigint")), 2, "0") for q in range(PARTS)]))
    rows = scratch.keep(found.rows.select("vec_id", "label", code.alias("code"), "error"), "codes")
    labels = scratch.keep(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    return rows.alias("a").join(labels.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label"))).select("vec_id", "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a step's tables by number, distances as sums of products (exact in doubles for components of embeddings)."""
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(f"""near{t} AS MATERIALIZED (
  SELECT r, q, (m // 256)::BIGINT AS gap, (m % 256)::BIGINT AS k
  FROM (SELECT p.r, p.q, min((p.vv - 2 * list_inner_product(p.v, b.v) + b.vv)::HUGEINT * 256 + b.k) AS m FROM parts p JOIN book{t} b USING (q) GROUP BY p.r, p.q))""")
        if t < ROUNDS:
            steps.append(f"""book{t + 1} AS MATERIALIZED (
  SELECT q, k, v, list_inner_product(v, v) AS vv FROM (
    SELECT b.q, b.k, coalesce(any_value(n.v), any_value(b.v)) AS v FROM book{t} b LEFT JOIN (
      SELECT q, k, list(mean ORDER BY i) AS v FROM (
        SELECT n.q, n.k, i, floor(sum(p.v[i]) / count(*)) AS mean FROM near{t} n JOIN parts p USING (r, q), LATERAL (SELECT unnest(range(1, len(p.v) + 1)) AS i) GROUP BY ALL) GROUP BY q, k) n USING (q, k)
    GROUP BY b.q, b.k))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, q, v, list_inner_product(v, v) AS vv FROM (SELECT r, q, v[q * len(v) // {PARTS} + 1 : (q + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(q))
), book0 AS (SELECT q, r AS k, v, vv FROM parts WHERE r < {ENTRIES}),
{", ".join(steps)},
codes AS (SELECT r, string_agg(lower(printf('%02x', k)), '' ORDER BY q) AS code, sum(gap)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
said AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY q, k)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), said
"""


SQL = _sql()
