"""Connected components of an edge table, by alternating star contractions.

Each round hangs every neighbour of a node onto the smallest node it can see, first
over larger neighbours, then over smaller ones (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Rounds needed grow with the logarithm of
the number of nodes, every round is one pair of equi-joins and grouped minima. Minima
combine before the shuffle. A hub's edges meet its minimum in a join that is dealt over all
partitions: nodes with more edges than an even share of a partition are fewer than there are
partitions, and each of them is salted by the other end of its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from cairn.plans.durable import Scratch


def _kept(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` written, and what was counted on the way: their number and a sum over their hashes."""
    seen = Observation()
    out = scratch.keep(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), name)
    return out, (seen.get["n"], seen.get["mark"])


def _meet(edges: DataFrame, total: int, least: DataFrame, end: str, other: str) -> DataFrame:
    """``edges`` with ``m`` of ``least`` for the node at ``end``; hubs are spread by the node at ``other``."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # fewer than ``parts`` nodes can have more than an even share of the edges
    hubs = [r[end] for r in edges.groupBy(end).count().where(F.col("count") > max(total / parts, 64)).select(end).collect()] if total > 64 else []
    if not hubs:
        return edges.join(least.withColumnRenamed("u", end), end)
    hot = F.col(end).isin(hubs)
    salted = edges.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(other), F.lit(parts))).otherwise(F.lit(0).cast("bigint")))
    spread = least.withColumnRenamed("u", end).withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    return salted.join(spread, [end, "salt"]).drop("salt")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: kept, ``u`` above ``v``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _meet(edges, total, least, "v", "u").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: kept, ``u`` above ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = _meet(edges, total, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node with an edge; component is the smallest node reachable.

    Null ends, self loops and repeated edges are ignored. Nodes without an edge are not
    listed: they are their own component, which a left join restores.
    """
    found = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    found = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    (found, mark), seen = _kept(found, scratch, "edges"), None
    while mark != seen and mark[0]:
        large, n = _kept(_large_star(found, mark[0]), scratch, "large-star")
        nxt, new = _kept(_small_star(large, n[0]), scratch, "star")
        scratch.drop(found)
        scratch.drop(large)
        found, mark, seen = nxt, new, mark
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
