"""Pairs that a caller's predicate says belong together, within blocks, without a row for each pair.

Which rows could be a pair is said by block columns: only rows of one block are compared. A block
of many rows is cut into pieces of about ``piece`` rows by a hash, and each two pieces (and each
piece with itself) meet in a tile, which is one group of at most some ``2 * piece`` rows. Tiles are
spread over all tasks, so a block that holds a third of all rows does, too. In a tile pairs
are made and judged in batches of ``batch``; only those that the predicate accepts leave it.

What a predicate costs on a block is the square of the block, in any method that knows nothing of
the predicate; block columns are there to keep blocks small, and a symmetric predicate is asked once a pair.

A row with a null block column, or a null id, is in no pair. Two rows with the same id aren't a
pair; repeated rows are judged once each and a pair is returned once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Predicate = Callable[[list[tuple[dict, dict]]], list[bool]]


def tiles(rows: DataFrame, id_: str, block: list[str], piece: int) -> DataFrame:
    """``rows`` with ``_a``, ``_b`` (a tile of their block) and ``_own`` (their piece), once for each tile they are in."""
    sizes = rows.groupBy(*block).agg(F.count("*").alias("_n")).where("_n > 1")
    cut = rows.join(sizes, block).withColumn("_k", F.ceil(F.col("_n") / piece).cast("int")).withColumn("_own", F.pmod(F.xxhash64(id_), F.col("_k")).cast("int"))
    other = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return other.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other")).drop("_n", "_k", "_other")


def matching_pairs(rows: DataFrame, id_: str, block: list[str], columns: list[str], factory: Callable[[], Predicate], piece: int = 512, batch: int = 1024) -> DataFrame:
    """``(left_id, right_id)`` of the pairs of a block that the predicate accepts, the smaller id first. The predicate sees ``columns`` of both, smaller id first."""
    kind = rows.schema[id_].dataType.simpleString()
    clash = {"_a", "_b", "_own", "_n", "_k", "_other", "_id"} & {*block, *columns}
    if clash:
        raise ValueError(f"columns with names of the method: {sorted(clash)}")
    ok = F.col(id_).isNotNull()
    for c in block:
        ok = ok & F.col(c).isNotNull()
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(block)]
    named = rows.where(ok).select(F.col(id_).alias("_id"), *keys, F.struct(*columns).alias("_row") if columns else F.struct(F.lit(0).alias("_")).alias("_row")).distinct()
    dealt = tiles(named, "_id", [f"_key{i}" for i in range(len(block))], piece)

    def pairs(own: list[tuple], a: int, b: int) -> Iterator[tuple]:
        left = [r for r in own if r[2] == a]
        right = left if a == b else [r for r in own if r[2] == b]
        for i, x in enumerate(left):
            for y in right[i + 1 :] if a == b else right:
                if x[0] != y[0]:
                    yield (x, y) if x[0] < y[0] else (y, x)

    def judge(tile: pd.DataFrame) -> pd.DataFrame:
        predicate, out = factory(), []
        own = [(i, dict(r), p) for i, r, p in zip(tile["_id"], tile["_row"], tile["_own"], strict=True)]
        todo = pairs(own, int(tile["_a"].iloc[0]), int(tile["_b"].iloc[0]))
        while lot := list(islice(todo, batch)):
            said = predicate([(x[1], y[1]) for x, y in lot])
            if len(said) != len(lot):
                raise ValueError("a predicate gives one answer for each pair")
            out += [(x[0], y[0]) for (x, y), yes in zip(lot, said, strict=True) if yes]
        return pd.DataFrame(out, columns=["left_id", "right_id"])

    found = dealt.groupBy(*[f"_key{i}" for i in range(len(block))], "_a", "_b").applyInPandas(judge, f"left_id {kind}, right_id {kind}")
    return found.distinct()
