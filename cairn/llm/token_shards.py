"""Token ids in training order, in shards of fixed stride.

Each text becomes token ids and an end mark, cut into sequences of ``length`` ids (the last
one padded). Sequences are numbered densely, and a keyed Feistel permutation of
0..total-1 gives each its slot in the training order: a balanced Feistel network permutes
the next power of four, and values outside the range walk on along their cycle until they
fall inside. A slot's shard and row follow by division, so a reader that stopped at slot s
goes on at shard s div rows, byte (s mod rows) * stride: nothing has to be searched.

Tokenising happens once. Its output is written to the shared folder with the number of
sequences before each document in its partition; the partitions' totals are then a small
table of running sums (a row per partition). Slots are spread evenly by construction, so
each shard goes to the partition that its number names, with no sampling.

Null and empty texts are one sequence with just the end mark. Repeated rows are documents
of their own. Null ids are carried. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.functions import pandas_udf
import pandas as pd

from cairn.plans.durable import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public tokenizer's texts are cut before merging: contractions, words, digits, other signs, white space.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, and its free id for the end of a text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def tokenize(docs: DataFrame, length: int, path: str, carry: list[str]) -> DataFrame:
    """``carry``, part, before, n_tokens, n_seqs, ids: ids is little-endian uint16, padded to whole sequences with the end mark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL("part int, before bigint, n_tokens bigint, n_seqs bigint, ids binary")
    out = StructType([docs.schema[c] for c in carry] + extra.fields)
    names = list(dict.fromkeys([*carry, "text"]))
    types = [f.type for f in to_arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path)
        if end > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for text in b.column(names.index("text")).to_pylist():
                ids = np.array(tool.encode_ordinary(text), "<u2") if text else np.zeros(0, "<u2")
                n = len(ids) + 1
                seqs = -(-n // length)
                flat = np.full(seqs * length, end, "<u2")
                flat[: n - 1] = ids
                rows.append((part, before, n, seqs, flat.tobytes()))
                before += seqs
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(names.index(c)) for c in carry] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=out.names)

    return docs.select(*names).mapInArrow(run, out)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index: a permutation of 0..total-1 that depends on the key."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    left = np.arange(len(x))
    while len(left):
        a, b = x[left] >> shift, x[left] & mask
        for r in range(rounds):
            a, b = b, a ^ (_mix(b, key * 0x100000001B3 + r * 0x632BE59BD9B4E019) & mask)
        x[left] = (a << shift) | b
        left = left[x[left] >= np.uint64(total)]  # walk on along the cycle
    return x.astype(np.int64)


def training_order(docs: DataFrame, length: int = 1024, shard_rows: int = 4096, key: int = 20_240_201, path: str = TOKENIZER, carry: list[str] | None = None, partitions: int = 4096) -> DataFrame:
    """``(slot, shard, row_in_shard, <carry>, seq_no, n_tokens, tokens)``, in slot order inside each shard.

    tokens: ``length`` little-endian uint16; n_tokens: those before the padding. Shards are
    dealt to at most ``partitions`` tasks, in ranges.
    """
    carry = ["doc_id"] if carry is None else carry
    if clash := sorted({c.lower() for c in carry} & {"slot", "shard", "row_in_shard", "seq_no", "n_tokens", "tokens"}):
        raise ValueError(f"carried columns have names of the result's own: {clash}")
    docs = docs.select(F.struct(*carry).alias("carried"), "text")
    scratch = Scratch(docs.sparkSession, "token-shards")
    done = scratch.keep(tokenize(docs, length, path, ["carried"]), "tokens", compression="zstd")
    parts = done.groupBy("part").agg(F.sum("n_seqs").alias("seqs"))
    first = scratch.keep(parts.select("part", F.coalesce(F.sum("seqs").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "seqs"), "offsets")
    total = first.agg(F.sum("seqs")).first()[0] or 0

    @pandas_udf("bigint")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(np.int64), total, key))

    stride = 2 * length
    shards = -(-total // shard_rows)
    tasks = max(1, min(shards, partitions))
    # a document's ids are cut before they are exploded: a row then has its own sequence, not all of the document
    cut = F.transform(F.expr("sequence(0L, n_seqs - 1)"), lambda i: F.struct(i.alias("seq_no"), F.substring("ids", (i * stride + 1).cast("int"), F.lit(stride)).alias("tokens")))
    numbered = done.join(first.select("part", "first"), "part").select("carried", "n_tokens", (F.col("first") + F.col("before")).alias("index"), F.explode(cut).alias("seq"))
    placed = numbered.select(
        slot(F.col("index") + F.col("seq.seq_no")).alias("slot"), *[F.col(f"carried.{c}").alias(c) for c in carry], "seq.seq_no",
        F.least(F.col("n_tokens") - F.col("seq.seq_no") * length, F.lit(length)).alias("n_tokens"), "seq.tokens",
    )
    placed = placed.select("slot", F.expr(f"slot div {shard_rows}").alias("shard"), F.expr(f"int(slot % {shard_rows})").alias("row_in_shard"), *carry, "seq_no", "n_tokens", "tokens")
    return placed.repartitionById(tasks, F.expr(f"int(shard * {tasks} div {max(1, shards)})")).sortWithinPartitions("slot")


def materialise(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """Write the shards of ``training_order`` as a table, a range of shards to a file, and read them from there."""
    return scratch.keep(ordered, "shards", compression="zstd")


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Write the shards of ``training_order`` as plain binary files below ``uri``; ``(shard, rows, bytes)``.

    A file gets its name only when it is whole, so a task that is lost and runs again just
    replaces it. ``uri`` must be reachable from all executors (any file system that Arrow
    knows; on one machine a ``file://`` address).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        now, out, rows, size, done = None, None, 0, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(posixpath.join(base, f".{now:08d}.{task.taskAttemptId()}"), posixpath.join(base, f"shard-{now:08d}.bin"))
                done.append((now, rows, size))

        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shard != now:
                    close()
                    now, rows, size = shard, 0, 0
                    out = store.open_output_stream(posixpath.join(base, f".{now:08d}.{task.taskAttemptId()}"))
                raw = data.as_buffer()
                out.write(raw)
                rows, size = rows + 1, size + raw.size
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done, strict=True) if done else [[]] * 3)], names=["shard", "rows", "bytes"])

    return ordered.select("shard", "tokens").mapInArrow(run, "shard bigint, rows bigint, bytes bigint")


def read_slots(data: bytes, from_row: int, length: int = 1024) -> np.ndarray:
    """The sequences of a shard file from a row on, without reading what lies before."""
    return np.frombuffer(data, "<u2", offset=from_row * 2 * length).reshape(-1, length)
