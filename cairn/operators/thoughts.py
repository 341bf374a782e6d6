"""Searches over thoughts: from a plan's questions, thoughts are grown under budgets in one of four orders.

Many searches run side by side, one row each. A search keeps its thoughts and a frontier of
those not expanded yet, and takes from it the first (breadth first), the last (depth first),
the surest (best first), or the surest of the least depth (iterative). A step A step of a search
depends on the one before, but what a thought leads to doesn't: a round asks for the children
of all thoughts on all frontiers at once, in one join or one batch call, and each search then
goes on until it takes a thought that came in this very round. Breadth first and iterative
searches need a round for each level; depth first and best first ones one for each time they
go deeper, which is less than one for each thought, as siblings are asked about together.

A search holds at most ``nodes`` thoughts and as many lists of ``branches`` children: that
bounds a row. Rounds are written, so plans don't grow and a lost executor repeats tasks of one
round.

An expander is a function from ``(root, seq, node, depth, confidence)`` to ``(root, seq, place, node,
confidence, kind)``: children of thought ``seq`` in order of ``place``. Of more than ``branches`` children
the first ones count. A null confidence is below all others. A child is a thought of its own,
also if another has the same node; cycles end at the depth. Plans with a repeated root and
place keep one of the rows; without a root (place 0) a search has no result.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.plans.durable import Scratch

Expander = Callable[[DataFrame], DataFrame]
ORDERS = ("breadth_first", "depth_first", "best_first", "iterative")
#: Confidence of a plan's sub-questions.
SUB_QUESTION = 0.9


@dataclass(frozen=True)
class Budget:
    depth: int = 4
    branches: int = 4
    nodes: int = 64


class Frontier:
    """Thoughts not expanded yet, as ``(seq, depth, confidence)``; of equally good ones the earliest comes first."""

    def __init__(self, order: str):
        self.order, self.items = order, deque() if order in ("breadth_first", "depth_first") else []

    def push(self, seq: int, depth: int, confidence: float | None) -> None:
        if isinstance(self.items, deque):
            self.items.append((seq, depth))
        else:
            sure = math.inf if confidence is None or math.isnan(confidence) else -confidence
            heapq.heappush(self.items, (sure, seq, depth) if self.order == "best_first" else (depth, sure, seq))

    def peek(self) -> tuple[int, int] | None:
        """Seq and depth of the thought to be taken next."""
        if not self.items:
            return None
        top = self.items[-1 if self.order == "depth_first" else 0]
        return top if len(top) == 2 else (top[1], top[2]) if self.order == "best_first" else (top[2], top[0])

    def pop(self) -> None:
        if self.order == "depth_first":
            self.items.pop()
        elif self.order == "breadth_first":
            self.items.popleft()
        else:
            heapq.heappop(self.items)


def advance(thoughts: list[dict], waiting: list[int], children: dict[int, list[dict]], order: str, budget: Budget) -> tuple[list[int] | None, bool]:
    """Go on with one search as far as ``children`` of thoughts are known.

    thoughts: what there is, by seq; new ones are added, and those taken get their ``turn``.
    waiting: the frontier, in order of seq. Returns the new frontier, or None once the search has
    ended, and whether it ended for want of room.
    """
    frontier, turn = Frontier(order), 1 + max((t["turn"] for t in thoughts if t["turn"] is not None), default=-1)
    held = set(waiting)
    for seq in waiting:
        frontier.push(seq, thoughts[seq]["depth"], thoughts[seq]["confidence"])
    while (top := frontier.peek()) is not None:
        seq, depth = top
        if depth < budget.depth:
            if len(thoughts) >= budget.nodes:
                return None, True
            if seq not in children:
                return sorted(held), False
        frontier.pop()
        held.discard(seq)
        if depth >= budget.depth:
            continue
        thoughts[seq]["turn"], turn = turn, turn + 1
        for child in children[seq][: budget.branches]:
            if len(thoughts) >= budget.nodes:
                return None, True
            new = {"node": child["node"], "parent": seq, "depth": depth + 1, "confidence": child["confidence"], "kind": child["kind"], "turn": None}
            frontier.push(len(thoughts), new["depth"], new["confidence"])
            held.add(len(thoughts))
            thoughts.append(new)
    return None, False


_THOUGHT = "node: {0}, parent: int, depth: int, confidence: double, kind: string, turn: int"
_CHILD = "node: {0}, confidence: double, kind: string"


def _step(rows: DataFrame, order: str, budget: Budget) -> DataFrame:
    """Each search (root, thoughts, waiting, known, answers) after one round."""
    out: StructType = rows.drop("answers").schema
    types = {f.name: f.type for f in to_arrow_schema(out)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: dict[str, list] = {c: [] for c in types}
            for r in b.to_pylist():
                children: dict[int, list] = {seq: [] for seq in r["asked"]}
                children |= {k["seq"]: k["children"] for k in (r["known"] or []) + (r["answers"] or [])}
                waiting, full = advance(r["thoughts"], r["waiting"], children, order, budget)
                left = set(waiting or [])
                r["known"] = [{"seq": s, "children": c} for s, c in sorted(children.items()) if s in left]
                r["asked"] = sorted(s for s in children if s in left)
                r |= {"waiting": waiting or [], "ended": waiting is None, "exhausted": full}
                for c in types:
                    done[c].append(r[c])
            yield pa.RecordBatch.from_arrays([pa.array(done[c], t) for c, t in types.items()], names=list(types))

    return rows.mapInArrow(run, out)


def search(plans: DataFrame, expand: Expander, scratch: Scratch, order: str = "best_first", budget: Budget = Budget()) -> DataFrame:
    """``(root, seq, node, parent, depth, confidence, kind, turn, exhausted)``: all thoughts of each search in the order they came.

    plans: (root, place, node, confidence), the root's own question at place 0 and sub-questions
    behind it. turn: when a thought was expanded, null if it wasn't; exhausted: a budget ended
    the search while there was a thought to expand.
    """
    if order not in ORDERS:
        raise ValueError(f"no such order: {order}")
    kind = plans.schema["node"].dataType.simpleString()
    thought = f"array<struct<{_THOUGHT.format(kind)}>>"
    known = f"array<struct<seq: int, children: array<struct<{_CHILD.format(kind)}>>>>"
    first = plans.dropDuplicates(["root", "place"]).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "node", "confidence"))).alias("p")).where(F.col("p")[0]["place"] == 0)
    begun = F.transform("p", lambda x, i: F.struct(x["node"].alias("node"), F.when(i > 0, 0).alias("parent"), F.when(i > 0, 1).otherwise(0).alias("depth"), x["confidence"].cast("double").alias("confidence"), F.lit("question").alias("kind"), F.lit(None).cast("int").alias("turn")))
    state = first.select("root", begun.cast(thought).alias("thoughts"), F.sequence(F.lit(0), F.size("p") - 1).alias("waiting"), F.array().cast("array<int>").alias("asked"), F.array().cast(known).alias("known"), F.lit(False).alias("ended"), F.lit(False).alias("exhausted"))
    state, finished = scratch.keep(state, "plans"), []
    while not state.isEmpty():
        open_ = state.select("root", F.posexplode("thoughts").alias("seq", "t"), "waiting", "asked")
        open_ = open_.where(F.array_contains("waiting", F.col("seq")) & ~F.array_contains("asked", F.col("seq")) & (F.col("t.depth") < budget.depth))
        asked = open_.select("root", "seq", "t.node", "t.depth", "t.confidence")
        ranked = Window.partitionBy("root", "seq").orderBy("place", "node")
        answers = expand(asked).withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= budget.branches)
        child = F.struct("node", F.col("confidence").cast("double").alias("confidence"), F.col("kind").cast("string").alias("kind"))
        answers = answers.groupBy("root", "seq").agg(F.array_sort(F.collect_list(F.struct("_n", child.alias("c")))).alias("c")).select("root", F.struct("seq", F.transform("c", lambda x: x["c"]).alias("children")).alias("a"))
        answers = answers.groupBy("root").agg(F.collect_list("a").cast(known).alias("answers"))
        now = F.filter("waiting", lambda i: F.get("thoughts", i)["depth"] < budget.depth)
        rows = state.join(answers, "root", "left").withColumn("asked", now)
        after = scratch.keep(_step(rows, order, budget), "round")
        finished.append(after.where("ended"))
        state = after.where("NOT ended")
    if not finished:
        return state.select("root", F.posexplode("thoughts").alias("seq", "t"), "exhausted").select("root", "seq", "t.*", "exhausted")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("root", F.posexplode("thoughts").alias("seq", "t"), "exhausted").select("root", "seq", "t.*", "exhausted")


def plan(questions: DataFrame, sub_questions: DataFrame | None = None) -> DataFrame:
    """Plans of ``questions`` (root, node), which are certain, and ``sub_questions`` (root, place from 1 on, node)."""
    own = questions.select("root", F.lit(0).alias("place"), "node", F.lit(1.0).alias("confidence"))
    return own if sub_questions is None else own.unionByName(sub_questions.join(questions.select("root").distinct(), "root", "left_semi").select("root", F.col("place").cast("int").alias("place"), "node", F.lit(SUB_QUESTION).alias("confidence")))


def by_table(steps: DataFrame, branches: int) -> Expander:
    """An expander that looks children up: steps (src, dst, confidence, kind), the surest first.

    Only a node's first ``branches`` steps are joined; Spark limits them before they are shuffled,
    so a node with very many steps is no burden to one task.
    """
    first = Window.partitionBy("src").orderBy(F.col("confidence").desc_nulls_last(), "dst", "kind")
    kept = steps.select("src", "dst", "confidence", "kind").withColumn("place", F.row_number().over(first)).where(F.col("place") <= branches)

    def expand(asked: DataFrame) -> DataFrame:
        return asked.select("root", "seq", F.col("node").alias("src")).join(kept, "src").select("root", "seq", "place", F.col("dst").alias("node"), "confidence", "kind")

    return expand


def paths(thoughts: DataFrame, budget: Budget, scratch: Scratch) -> DataFrame:
    """``(root, leaf, seqs, confidences, concludes)``: each way from the root to a thought without children, a level at a time.

    concludes: the last thought is a conclusion.
    """
    level = thoughts.where("parent IS NULL").select("root", F.col("seq").alias("leaf"), F.array("seq").alias("seqs"), F.array("confidence").alias("confidences"), (F.col("kind") == "conclusion").alias("concludes"))
    steps = thoughts.where("parent IS NOT NULL").select("root", F.col("parent").alias("leaf"), "seq", "confidence", "kind")
    inner = steps.select("root", "leaf").distinct()
    out = None
    for _ in range(budget.depth + 1):
        ended = level.join(inner, ["root", "leaf"], "left_anti")
        out = ended if out is None else out.unionByName(ended)
        level = scratch.keep(level.join(steps, ["root", "leaf"]).select("root", F.col("seq").alias("leaf"), F.concat("seqs", F.array("seq")).alias("seqs"), F.concat("confidences", F.array("confidence")).alias("confidences"), (F.col("kind") == "conclusion").alias("concludes")), "level")
        if level.isEmpty():
            break
    return out
