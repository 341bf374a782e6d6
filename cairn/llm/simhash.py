"""Near duplicates by SimHash, searched with vantage-point trees.

Fingerprints. A text's words, lower-cased in A-Z only, are what lies between the
characters of [\\x20\\x09-\\x0D]. Each shingle of ``shingle`` words (the whole sequence if
there are fewer) counts, repeats included, with its XXH64 (seed 42); a bit of the
fingerprint is set if it is set in over half of the hashes. No words: zero.

Search. Equal fingerprints become one class first, so that a group of exact copies of any
size is one row. The classes are dealt out by a vantage-point tree that was fitted on a
bounded sample: at each node a fingerprint goes to the inside or outside by its Hamming
distance to the vantage point; it has one home leaf, and it visits as a query every leaf
whose side the triangle bound can't exclude (distance within ``radius`` of the split). A
pair within the radius thus meets in the home leaf of each of the two. Every leaf is a
shard: there, a second, local tree is searched in numpy.

A local search returns a spanning forest of what it links, not all pairs: points that are
in one part already need no further comparison, and a subtree that lies in one part is
skipped by queries of that part. So a dense group of near copies costs about its size.

Null and empty texts have fingerprint zero, and link with any fingerprint of at most
``radius`` set bits. Ties and repeated rows are of no account; a null ``doc_id`` is never a
component's id unless all ids of the component are null. Extra columns are ignored. An
empty table gives an empty result. A component is numbered by its smallest ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cairn.llm.batches import map_texts
from cairn.operators.components import connected_components
from cairn.plans.durable import Scratch

_UPPER = {i: i + 32 for i in range(65, 91)}


def words(text: str) -> list[str]:
    """The words of a text; other white space than the six ASCII characters is part of them."""
    text = text.lower() if text.isascii() else text.translate(_UPPER)
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    return list(filter(None, text.split(" ")))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    ws = words(text) if text else []
    digest = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return np.array([digest(" ".join(ws).encode("utf-8", "surrogatepass"), 42)] if ws else [], np.uint64)
    runs = [ws[i : len(ws) - shingle + 1 + i] for i in range(shingle)]
    return np.fromiter((digest(s, 42) for s in map(" ".join, zip(*runs, strict=True))), np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""

    def make():
        return lambda texts: [np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return map_texts(docs, "text", ["doc_id"], "fp bigint", make)


class VantageTree:
    """A vantage-point tree over 64-bit fingerprints, kept as arrays.

    Each inner node has a vantage point and a split distance: nearer than the split is
    inside. Leaves are numbered. A node that no vantage point splits is a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int, radius: int = 3, seed: int = 7, tries: int = 12):
        self.radius = radius
        self.vantage: list[int] = []
        self.split: list[int] = []
        self.children: list[tuple[int, int]] = []  # a leaf's number is -1 - child
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(points, None)]
        while todo:
            own, parent = todo.pop()
            best = self._choose(own, rng, tries) if len(own) > leaf else None
            if best is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                me = len(self.vantage)
                v, s = best
                self.vantage.append(int(v))
                self.split.append(int(s))
                self.children.append((0, 0))
                near = np.bitwise_count(own ^ v) < s
                todo += [(own[near], (me, 0)), (own[~near], (me, 1))]
            if parent is not None:
                pair = list(self.children[parent[0]])
                pair[parent[1]] = me
                self.children[parent[0]] = tuple(pair)

    def _choose(self, own: np.ndarray, rng: np.random.Generator, tries: int):
        """The vantage point and split that leave the fewest expected visits: balanced, with few points near the boundary."""
        some = own if len(own) <= 2048 else rng.choice(own, 2048, replace=False)
        best, cost = None, 0.0
        for v in rng.choice(own, min(tries, len(own)), replace=False):
            hist = np.bincount(np.bitwise_count(some ^ v), minlength=66)
            inside = np.concatenate([[0], np.cumsum(hist)])[:66]  # inside[s]: points nearer than s
            s = np.arange(66)
            both = inside[np.minimum(65, s + self.radius)] - inside[np.maximum(0, s - self.radius)]
            share = inside / len(some)
            visits = (share**2 + (1 - share) ** 2 + both / len(some) * np.minimum(share, 1 - share) * 2)[1:65]
            k = int(np.argmin(visits))
            if 0.02 < share[k + 1] < 0.98 and (best is None or visits[k] < cost):
                best, cost = (v, k + 1), visits[k]
        return best

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index, leaf, home)``: each point once in its home leaf, and as a query in each further leaf its ball may touch."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(0 if self.vantage else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, idx, home = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                out.append((idx, -1 - node, home))
                continue
            d, s = np.bitwise_count(points[idx] ^ np.uint64(self.vantage[node])).astype(np.int64), self.split[node]
            near, far = self.children[node]
            a, b = d - self.radius < s, d + self.radius >= s
            todo += [(near, idx[a], home[a] & (d[a] < s)), (far, idx[b], home[b] & (d[b] >= s))]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])


class _Parts:
    """Disjoint parts of 0..n-1, with labels that whole arrays can be compared by."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join a[i] with b[i]; which of these pairs a spanning forest needs."""
        la, lb = self.label[a], self.label[b]
        ids, inv = np.unique(np.concatenate([la, lb]), return_inverse=True)
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        used = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(inv[: len(a)].tolist(), inv[len(a) :].tolist(), strict=True)):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                used[i] = True
        if used.any():
            new = ids[[find(x) for x in range(len(ids))]]
            at = np.searchsorted(ids, self.label)
            hit = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == self.label)
            self.label[hit] = new[at[hit]]
        return used


def near_links(points: np.ndarray, home: np.ndarray, radius: int = 3, leaf: int = 256) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indices, of the links between distinct points of which one is at home here."""
    members = np.flatnonzero(home)
    parts, forest = _Parts(len(points)), []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        used = parts.link(a, b)
        forest.extend(zip(a[used].tolist(), b[used].tolist(), strict=True))

    if not len(members):
        return forest
    tree = VantageTree(points[members], leaf, radius, seed=11, tries=6)
    idx, leaf_of, at_home = tree.deal(points)
    order = np.argsort(leaf_of, kind="stable")
    idx, leaf_of, at_home = idx[order], leaf_of[order], at_home[order]
    cuts = np.flatnonzero(np.diff(leaf_of)) + 1
    for qs, hs in zip(np.split(idx, cuts), np.split(at_home, cuts), strict=True):
        own = qs[hs & home[qs]]
        for at in range(0, len(own), leaf):
            block = own[at : at + leaf]
            # The block is linked within itself first. Queries of the part that most of it lies in are then compared
            # with the rest of the block only: in a dense group that is next to nothing.
            for lot in [block, *(qs[i : i + 4096] for i in range(0, len(qs), 4096))]:
                labels = parts.label[block]
                parts_here, sizes = np.unique(labels, return_counts=True)
                most = parts_here[np.argmax(sizes)]
                inside = parts.label[lot] == most
                for ask, of in ((lot[~inside], block), (lot[inside], block[labels != most])):
                    if not len(ask) or not len(of):
                        continue
                    a, b = np.nonzero(np.bitwise_count(points[ask][:, None] ^ points[of][None, :]) <= radius)
                    a, b = ask[a], of[b]
                    new = parts.label[a] != parts.label[b]
                    if new.any():
                        a, b = a[new], b[new]
                        # one link of each query to each part is enough
                        _, first = np.unique(a * np.int64(len(points)) + parts.label[b], return_index=True)
                        add(a[first], b[first])
    return forest


def near_components(fps: DataFrame, scratch: Scratch, radius: int = 3, sample: int = 1 << 16, shard: int = 1 << 16) -> DataFrame:
    """``(fp, component_fp)`` for distinct fingerprints that have a link; exact for the radius.

    fps: distinct ``fp``. The tree is fitted on at most ``sample`` fingerprints and sent with
    the tasks (under 1 MB); all fingerprints are indexed. ``shard`` is the aim for the number
    of fingerprints at home in a leaf.
    """
    total = fps.count()
    share = min(1.0, sample / max(total, 1))
    cut = int(share * (1 << 32))
    picked = fps if share == 1.0 else fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < cut)
    # the bounded sample that the tree is fitted on, and no more of the fingerprints than that
    got = picked.limit(2 * sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = VantageTree(np.sort(got), max(64, int(shard * share)), radius)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            own = p["fp"].to_numpy(np.int64)
            idx, leaf, home = tree.deal(own.view(np.uint64))
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": own[idx], "home": home})

    def search(p: pd.DataFrame) -> pd.DataFrame:
        own = p.sort_values("fp")
        points = own["fp"].to_numpy(np.int64)
        links = np.array(near_links(points.view(np.uint64), own["home"].to_numpy(bool), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": points[links[:, 0]], "b": points[links[:, 1]]})

    dealt = fps.mapInPandas(deal, "leaf int, fp bigint, home boolean")
    links = dealt.groupBy("leaf").applyInPandas(search, "a bigint, b bigint")
    return connected_components(links, "a", "b", scratch).select(F.col("node").alias("fp"), F.col("component").alias("component_fp"))


#: Seeds of the min-hashes that bring likely pairs together.
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def members_of(hashes: np.ndarray) -> np.ndarray:
    """A shingle set: the sorted distinct upper halves of the shingles' hashes."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))


def sketch(text: str | None, shingle: int = 5) -> tuple[int, list[int], bytes]:
    """``(fingerprint, min-hashes, shingle set)`` of a text."""
    hashes = shingle_hashes(text, shingle)
    own = members_of(hashes)
    if not len(own):
        return 0, [], b""
    x = own.astype(np.uint64)[:, None] + _SEEDS[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    least = (x ^ (x >> np.uint64(31))).min(0)
    return int(np.uint64(majority(hashes)).view(np.int64)), least.view(np.int64).tolist(), own.tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """The share of two shingle sets' members that both have; two empty sets are equal."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def likely_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs within the radius that hold each part together, the nearest first, and each point's two nearest.

    Blocks of more than 256 points give forests from vantage-point trees, one for each of several
    radii up to that: a near pair is held together by near pairs.
    """
    n = len(points)
    if n > 256:
        return sorted(set().union(*(near_links(points, np.ones(n, bool), r) for r in range(4, radius + 1, 4))))
    d = np.bitwise_count(points[:, None] ^ points[None, :]).astype(np.int64)
    a, b = np.nonzero(np.triu(d <= radius, 1))
    order = np.argsort(d[a, b], kind="stable")
    a, b = a[order], b[order]
    picked = _Parts(n).link(a, b)
    met = np.zeros(n, np.int64)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if met[x] < 2 or met[y] < 2:
            picked[i] = True
        met[x] += 1
        met[y] += 1
    return list(zip(a[picked].tolist(), b[picked].tolist(), strict=True))


#: Words of 64 marks that may be sent to all tasks: 16 MB, for up to 64 million rows.
_FEW = 1_000_000
#: The least members of a set that are looked at first, and how far the share among them may be below the similarity:
#: five standard deviations at 0.8, so that a pair of that similarity is passed over with probability 0.0000003.
_HEAD, _DOUBT = 64, 0.25
#: Bits in which two texts may differ to be checked by the second search: two of similarity 0.8 differ in more with probability 0.00005.
_NEAR = 21


def head_share(x: np.ndarray, y: np.ndarray) -> float:
    """What the least members of two sets say of the similarity of the sets; exact if these have no others."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    same = both[1:][both[1:] == both[:-1]]  # members are distinct within a set
    least = np.unique(both)[:_HEAD]
    return float((same <= least[-1]).sum() / len(least))


def _among(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``rows`` whose number ``row`` is one of ``ids``.

    A mark for each row goes to where the rows are, 64 to a word, so that no text is moved. Of
    rows too many for that, rows and ids meet in a shuffle.
    """
    words = ids.groupBy(F.shiftright("row", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(row & 63))")).alias("marks"))
    words = scratch.keep(words, "marks")
    if words.count() > _FEW:
        return rows.join(ids, "row", "left_semi")
    marked = rows.withColumn("word", F.shiftright("row", 6)).join(F.broadcast(words), "word")
    return marked.where(F.expr("shiftright(marks, int(row & 63)) & 1 = 1")).select(*rows.columns)


def _tiles(members: DataFrame, piece: int, chunk: int, weight: Column | None = None) -> DataFrame:
    """``members`` (key, row, part, ...) dealt into tiles (key, p, r) of at most about ``piece + chunk`` rows, or of that ``weight``.

    In each key the largest part needs no comparison within itself: the others' rows, ``ask``, meet all
    rows. A row is once in its own piece for each chunk of those that ask, and one that asks
    is once in its chunk for each piece: up to ``piece`` rows a key, that is twice at most.
    """
    sizes = members.groupBy("key", "part").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    cut = members.join(keys.select("key", "main", F.ceil(F.col("n") / piece).cast("int").alias("ps"), F.ceil((F.col("n") - F.col("most")) / chunk).cast("int").alias("rs")), "key")
    at = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda r: F.struct(at(1, "ps").alias("p"), r.alias("r"), F.lit(False).alias("ask")))
    asks = F.when(F.col("part") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), at(2, "rs").alias("r"), F.lit(True).alias("ask")))).otherwise(F.array().cast("array<struct<p:int,r:int,ask:boolean>>"))
    return cut.select(*members.columns, F.explode(F.concat(own, asks)).alias("t")).select(*members.columns, "t.*")


def _apart(fps: np.ndarray, sizes: np.ndarray, parts: np.ndarray, ask: np.ndarray, radius: int, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a tile (one that asks, one of its own) of different parts whose fingerprints are near and whose sets' sizes allow the similarity."""
    q, o = np.flatnonzero(ask), np.flatnonzero(~ask)
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        a, b = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[o][None, :]) <= radius)
        a, b = some[a], o[b]
        fit = (parts[a] != parts[b]) & (np.minimum(sizes[a], sizes[b]) >= similar * np.maximum(sizes[a], sizes[b]))
        yield a[fit], b[fit]


def missed(members: DataFrame, sets_of: Callable[..., DataFrame], scratch: Scratch, similar: float, radius: int, piece: int = 4096) -> DataFrame:
    """``(a, b)``: links between points of one key that aren't in one part yet.

    members: (key, i, row, fp, part, size of the set), i the place of the key among a row's min-hashes; sets_of: for ids, (row, keys, sh). Rows that have a near one of another part are found
    by fingerprints alone; only these are brought together with their sets. A pair is checked once its
    parts are apart and the least members of their sets don't tell them apart, the nearest first; links that a tile finds join its parts at once.
    """
    order = ["key", "p", "r", "ask", "row"]
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def by_tile(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
        """``use`` with the columns of each whole tile; rows come in order of tiles."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key, p, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "p", "r"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(r) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                now = (key[lo], p[lo], r[lo])
                if held and now != last:
                    yield from use(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from use(pa.Table.from_batches(held).combine_chunks())

    def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(t.column(c).to_numpy() for c in ("row", "fp", "size", "part", "ask"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(t: pa.Table) -> Iterator[pa.RecordBatch]:
            row, fp, size, part, ask = columns(t)
            hit = np.zeros(len(row), bool)
            for a, b in _apart(fp.view(np.uint64), size, part, ask, radius, similar):
                hit[a] = hit[b] = True
            if hit.any():
                rows = np.unique(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t.column("key")[0].as_py())), pa.array(rows)], names=["key", "row"])

        return by_tile(batches, use)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(t: pa.Table) -> Iterator[pa.RecordBatch]:
            row, fp, size, part, ask = columns(t)
            heads = [np.frombuffer(x, "<u4") for x in t.column("sh").to_pylist()]
            hit = np.zeros(len(row), bool)
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
            for a, b in _apart(fp.view(np.uint64), size, part, ask, radius, similar):
                # a pair is looked at where it meets first
                here = ~(hit[a] & hit[b])
                here[here] = ~(keys[a[here], : t.column("i")[0].as_py()] == keys[b[here], : t.column("i")[0].as_py()]).any(1)
                for x, y in zip(a[here].tolist(), b[here].tolist(), strict=True):
                    if not (hit[x] and hit[y]) and head_share(heads[x], heads[y]) >= similar - _DOUBT:
                        hit[x] = hit[y] = True
            if hit.any():
                rows = np.unique(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t.column("key")[0].as_py())), pa.array(rows)], names=["key", "row"])

        return by_tile(batches, use)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def use(t: pa.Table) -> Iterator[pa.RecordBatch]:
            row, fp, size, part, ask = columns(t)
            own, links = t.column("sh").to_pylist(), []
            _, label = np.unique(part, return_inverse=True)
            for a, b in _apart(fp.view(np.uint64), size, part, ask, radius, similar):
                open_ = label[a] != label[b]
                a, b = a[open_], b[open_]
                for i in np.argsort(np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)), kind="stable").tolist():
                    x, y = int(a[i]), int(b[i])
                    if label[x] != label[y] and jaccard(own[x], own[y]) >= similar:
                        label[label == label[y]] = label[x]
                        links.append((min(row[x], row[y]), max(row[x], row[y])))
            if links:
                found = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        return by_tile(batches, use)

    def dealt(rows: DataFrame, *more: str, weight: Column | None = None) -> DataFrame:
        tiles = _tiles(rows, piece, piece, weight).select(*order, "fp", "part", "size", *more)
        return tiles.repartition(parts, "key", "p", "r").sortWithinPartitions(*order)

    held = scratch.keep(members, "members")
    hits = scratch.keep(dealt(held).mapInArrow(find, "key bigint, row bigint").distinct(), "apart")
    if hits.isEmpty():
        return scratch.spark.createDataFrame([], "a bigint, b bigint")
    own = sets_of(hits.select("row").distinct(), "keys")
    asked = held.join(hits, ["key", "row"])
    # most pairs are told apart by the least members of their sets
    heads = asked.join(own.select("row", "keys", F.expr(f"substring(sh, 1, {4 * _HEAD})").alias("sh")), "row")
    close = scratch.keep(dealt(heads, "i", "keys", "sh").mapInArrow(compare, "key bigint, row bigint").distinct(), "close")
    whole = asked.join(close, ["key", "row"]).join(own.select("row", "sh"), "row")
    # sets of usual length weigh as rows, longer ones as they need memory: a tile has 16 MB
    heavy = F.greatest(F.lit(1), F.ceil(F.col("size") / 512))
    return scratch.keep(dealt(whole, "sh", weight=heavy).mapInArrow(check, "a bigint, b bigint").distinct(), "missed")


def near_copies(docs: DataFrame, scratch: Scratch, shingle: int = 5, similar: float = 0.8, radius: int = 24, lot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``(rows, stays)``: the rows of ``docs`` as a struct ``doc`` with a number ``row``, and the numbers of those that stay, one of each component.

    A component's links are pairs of texts whose sets of ``shingle`` words have a Jaccard
    similarity of ``similar`` or more; of each component the row of the smallest ``doc_id``
    (null last), then number, is kept. 64-bit fingerprints are too short to be searched at such
    a radius among all others: a vantage-point tree would prune nothing. Fingerprints are
    therefore partitioned by six min-hashes first, of which two such texts share one with
    probability 1 - 0.2**6; searched by vantage-point trees in each part within ``radius`` bits (two such
    texts differ in 9.7 on average, with repeated words in up to 17 of those seen); and each
    link is checked exactly.
    Rows with equal sets are one point. A first search looks for the nearest of each point in parts
    of at most ``lot`` points (a larger one is cut by the other min-hashes of its points, once for
    each) and checks what it finds; that brings most copies together. A second one (``missed``)
    then takes all points of each whole part again, and checks every pair of it that is within 21
    bits and not together yet, so that no such link is lost that any part has.
    """
    carried = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))

    def make():
        return lambda texts: list(zip(*(sketch(t, shingle) for t in texts), strict=True)) or [[]] * 3

    def shingle_sets():
        return lambda texts: [[members_of(shingle_hashes(t, shingle)).tobytes() for t in texts]]

    # a set is as large as its text, and few are asked for: these are made again
    drawn = map_texts(carried, "text", ["doc"], "fp bigint, keys array<bigint>, sh binary", make).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(drawn.select("row", "doc", "fp", "keys", F.xxhash64("sh").alias("hash"), F.octet_length("sh").alias("bytes")), "sketches", compression="zstd")

    def sets_of(ids: DataFrame, *more: str) -> DataFrame:
        own = _among(rows.select("row", *more, F.col("doc.text").alias("text")), ids, scratch)
        return scratch.keep(map_texts(own, "text", ["row", *more], "sh binary", shingle_sets), "sets")

    if "doc_id" in docs.columns:
        first = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row")
    else:
        first = F.struct("row")
    narrow = rows.select("row", "fp", "hash", "bytes", first.alias("first"))
    # equal sets are one class, of any number of rows: one point of the search
    classes = scratch.keep(narrow.groupBy("fp", "hash", "bytes").agg(F.min("first").alias("first"), F.min("row").alias("rep")), "classes")
    points = rows.select("row", "fp", "keys").join(classes.select(F.col("rep").alias("row")), "row")
    each = points.select("row", "fp", "keys", F.posexplode("keys").alias("i", "key")).withColumn("key", F.xxhash64("i", "key"))
    sizes = each.groupBy("key").count().where("count > 1")
    shared = each.join(sizes, "key")
    cut = F.when(F.col("count") <= lot, F.array("key")).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda j: j != F.col("i")), lambda j: F.xxhash64("key", j, F.get("keys", j))))
    blocks = shared.select("row", "fp", F.explode(cut).alias("block"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their block."""
        now, held = None, []

        def links() -> pa.RecordBatch | None:
            ids, fps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            if len(ids) < 2:
                return None
            found = np.array(likely_links(fps.view(np.uint64), radius), np.int64).reshape(-1, 2)
            a, b = ids[found[:, 0]], ids[found[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            block, row, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                if not len(at):
                    continue
                if held and block[at[0]] != now:
                    if (got := links()) is not None:
                        yield got
                    held = []
                now = block[at[0]]
                held.append((row[at], fp[at]))
        if held and (got := links()) is not None:
            yield got

    dealt = blocks.select("block", "row", "fp").repartition(parts, "block").sortWithinPartitions("block", "row")
    likely = scratch.keep(dealt.mapInArrow(search, "a bigint, b bigint").distinct(), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = sets_of(ends)
    pairs = likely.join(sets.select(F.col("row").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("sh").alias("sb")), "b")

    @pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    links = scratch.keep(pairs.select("a", "b", alike("sa", "sb").alias("j")).where(F.col("j") >= similar).select("a", "b"), "links")
    scratch.drop(sets)
    parts_of = connected_components(links, "a", "b", scratch)
    members = each.join(parts_of.withColumnRenamed("node", "row"), "row", "left").select("key", "i", "row", "fp", F.coalesce("component", "row").alias("part"))
    more = missed(members.join(classes.select(F.col("rep").alias("row"), (F.col("bytes") / 4).cast("int").alias("size")), "row"), sets_of, scratch, similar, min(radius, _NEAR))
    if not more.isEmpty():
        parts_of = connected_components(links.unionByName(more), "a", "b", scratch)
    best = classes.join(parts_of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    kept = best.groupBy("group").agg(F.min("first").alias("first"))
    # one row of each group stays; all the others of all its classes go
    stays = kept.select(F.col("first.row").alias("row"))
    return rows.select("row", "doc"), stays


def stay(rows: DataFrame, stays: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that stay, of what ``near_copies`` returns."""
    return _among(rows, stays, scratch).select("doc.*")


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, shingle), "fingerprints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = near_components(classes.select("fp"), scratch, radius)
    linked = classes.join(parts, "fp")
    least = linked.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    ids = scratch.keep(classes.join(parts, "fp", "left").join(least, "component_fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "ids")
    # exact copies may be a third of the rows: the join with one row per class is split by Spark where it is skewed
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
