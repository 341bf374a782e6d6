"""The concept graph: neighbours, bounded traversals, visibility, supersession and drift.

Traversals go level by level. A level is one join of the frontier with the edges, which
Spark can broadcast if the frontier is small; nodes seen before leave by an anti-join, so
that a node is expanded once. Levels are written out, so that plans don't grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.components import connected_components
from cairn.plans.durable import Scratch


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(from, to, relation, id)`` of edges in a direction: out, in or both."""
    forward = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "id")
    backward = edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "relation", "id")
    return {"out": forward, "in": backward, "both": forward.union(backward)}[direction]


def edge_passes(relations: list[str] | None, scopes: list[str] | None) -> Column:
    """An edge's relation and scope are among those asked for; none asked for is any."""
    ok = F.lit(True)
    if relations:
        ok = ok & F.col("relation").isin(relations)
    if scopes:
        ok = ok & F.col("scope_id").isin(scopes)
    return ok


def neighbours(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    out = edges.where(F.col("src") == node)
    return (out if relation is None else out.where(F.col("relation") == relation)).select(F.col("dst").alias("id")).distinct()


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges that touch a node, those that leave it first."""
    own = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return own.withColumn("place", F.when(F.col("src") == node, 0).otherwise(1))


def traverse(edges: DataFrame, starts: DataFrame, depth: int, scratch: Scratch, direction: str = "out", relations: list[str] | None = None, scopes: list[str] | None = None) -> DataFrame:
    """``(start, id, depth, via)`` of nodes within a number of hops, at their least depth; the smallest predecessor counts."""
    steps = directed(edges.where(edge_passes(relations, scopes)), direction).select("from", "to")
    seen = scratch.keep(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), "level")
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select("start", F.col("id").alias("from")).join(steps, "from")
        new = step.groupBy("start", F.col("to").alias("id")).agg(F.min("from").alias("via")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = scratch.keep(new.select("start", "id", F.lit(level).alias("depth"), "via"), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def visible(nodes: DataFrame, states: list[str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Nodes in one of the states, in scopes that may be seen."""
    own = nodes if states is None else nodes.where(F.col("state").isin(states))
    return own if scopes is None else own.join(scopes.select("scope_id").distinct(), "scope_id", "left_semi")


def explore(nodes: DataFrame, edges: DataFrame, start: str, depth: int, cap: int, scratch: Scratch) -> DataFrame:
    """The first ``cap`` visible nodes by depth and id from a start, over edges between visible nodes."""
    shown = nodes.select("id")
    inner = edges.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "src", "dst", "relation", "scope_id")
    found = traverse(inner, shown.where(F.col("id") == start), depth, scratch, "both")
    return found.orderBy("depth", "id").limit(cap).select("id", "depth")


def communities(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of canonical nodes; a node with no edge to another is its own community."""
    own = nodes.where("state = 'canonical'").select("id")
    inner = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    parts = connected_components(inner.select("src", "dst"), "src", "dst", scratch)
    return own.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def remove_node(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").select("id").union(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("id")).distinct()


def supersede(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with those superseded that a pair (predecessor, successor) names; none by itself."""
    by = pairs.where("predecessor <> successor").groupBy(F.col("predecessor").alias("id")).agg(F.min("successor").alias("superseded_by"))
    return nodes.join(by, "id", "left").withColumn("state", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("state")))


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of canonical claims of a scope with equal core and opposite polarity.

    An equi-join on scope and core: claims are only compared with those they may contradict.
    """
    from cairn.functions.text import polarity

    own = claims.where("state = 'canonical'").select("id", "scope_id", polarity(F.col("label")).alias("p")).select("id", "scope_id", "p.*").where("core <> ''")
    yes, no = own.where("NOT negated"), own.where("negated")
    pairs = yes.select("scope_id", "core", F.col("id").alias("a")).join(no.select("scope_id", "core", F.col("id").alias("b")), ["scope_id", "core"])
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "core")


def drift(snapshots: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Why canonical nodes have drifted from their evidence: removed, then superseded, then weakened."""
    base, left = F.size("baseline"), F.size("still_valid")
    reason = F.when(F.size("removed") > 0, "evidence_removed").when(F.size("superseded") > 0, "evidence_superseded").when(left / base < ratio, "evidence_weakened")
    return snapshots.where(base > 0).select("id", reason.alias("reason"), base.alias("at_promotion"), left.alias("remaining")).where("reason IS NOT NULL")


def path_score(relations: Column, weights: dict[str, float], penalty: float = 0.05) -> Column:
    """The geometric mean of the relations' weights, less a penalty for each hop."""
    weight = lambda r: F.coalesce(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])[r], F.lit(1.0))
    mean = F.pow(F.aggregate(relations, F.lit(1.0), lambda a, r: a * weight(r)), 1 / F.size(relations))
    return F.when(F.size(relations) == 0, 1.0).otherwise(F.least(F.greatest(mean * (1 - F.least(penalty * F.size(relations), F.lit(1.0))), F.lit(0.0)), F.lit(1.0)))


def thought_score(confidences: Column, concludes: Column) -> Column:
    """Mean confidence of a path, 5 % less for each further step, and a bonus for a conclusion."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / F.size(confidences) * F.pow(F.lit(0.95), F.size(confidences) - 1)
    return F.when(concludes, F.least(mean + 0.1, F.lit(1.0))).otherwise(mean)


def patterns(traces: DataFrame, support: int) -> DataFrame:
    """Chains of steps up to the first success, by class, with support and rate of success.

    traces: (id, class, steps array<struct<mode, ok>>).
    """
    first = F.array_position(F.transform("steps", lambda s: s["ok"]), True)
    chain = F.transform(F.slice("steps", F.lit(1), F.when(first > 0, first.cast("int")).otherwise(F.size("steps"))), lambda s: s["mode"])
    grouped = traces.groupBy("class", F.array_join(chain, ">").alias("chain")).agg(F.count("*").alias("support"), F.avg(F.when(first > 0, 1.0).otherwise(0.0)).alias("success_rate"))
    return grouped.where(F.col("support") >= support)


def best_pattern(found: DataFrame) -> DataFrame:
    newest = Window.partitionBy("class").orderBy(F.desc("success_rate"), F.desc("support"), "chain")
    return found.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new`` whose id isn't taken; of new rows with one id, one is added."""
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def prefix_negations(labels: DataFrame) -> DataFrame:
    """``(left_id, right_id)`` where the second label is the first one after "not "."""
    plain = labels.select(F.col("id").alias("left_id"), F.concat(F.lit("not "), F.lower("label")).alias("k"))
    return plain.join(labels.select(F.col("id").alias("right_id"), F.lower("label").alias("k")), "k").select("left_id", "right_id")


def adjudicate(events: DataFrame) -> DataFrame:
    """``(id, state, refused)`` of contradictions after their events: detect, review, resolve, in order of ``t``.

    The first detect opens a case. A review is legal only while the case is detected; a resolve is
    legal until the case is resolved. Events that aren't legal are refused and change nothing.
    An id that is never detected has no case. Only minima and counts are shuffled.
    """
    first = lambda rows: rows.groupBy("id").agg(F.min("t").alias("at"))
    opened = first(events.where("kind = 'detect'"))
    later = events.join(opened.withColumnRenamed("at", "opened"), "id").where(F.col("t") > F.col("opened"))
    closed = first(later.where("kind = 'resolve'")).withColumnRenamed("at", "closed")
    seen = first(later.where("kind = 'review'").join(closed, "id", "left").where(F.col("closed").isNull() | (F.col("t") < F.col("closed")))).withColumnRenamed("at", "seen")
    done = opened.join(closed, "id", "left").join(seen, "id", "left").join(events.groupBy("id").agg(F.count("*").alias("n")), "id")
    state = F.when(F.col("closed").isNotNull(), "resolved").when(F.col("seen").isNotNull(), "under_review").otherwise("detected")
    return done.select("id", state.alias("state"), (F.col("n") - 1 - F.col("closed").isNotNull().cast("bigint") - F.col("seen").isNotNull().cast("bigint")).alias("refused"))


def plan(root: str, questions: DataFrame, confidence: float = 0.9) -> DataFrame:
    """``(root, node, confidence)``: a plan's root, which is certain, and its sub-questions (column ``question``)."""
    own = questions.sparkSession.range(1).select(F.lit(root).alias("root"), F.lit(root).alias("node"), F.lit(1.0).alias("confidence"))
    return own.union(questions.select(F.lit(root), "question", F.lit(confidence)))


def expand_thoughts(roots: DataFrame, steps: DataFrame, depth: int, branch: int, most: int) -> DataFrame:
    """``(root, node, depth, score)`` of thoughts grown from each root (column ``id``), breadth first, under three budgets.

    steps: (src, dst, weight). A thought has at most ``branch`` children, those of the highest weight;
    its score is the product of the weights on the way, and a thought that is met again stays at
    its least depth. Of each root the first ``most`` thoughts by depth, score and id are kept. A
    level is one join; levels are as many as the depth, not as the thoughts.
    """
    best = steps.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ranked = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    kids = best.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= branch).select(F.col("src").alias("node"), F.col("dst").alias("next"), "weight")
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"))
    grown = level
    for _ in range(depth):
        level = level.join(kids, "node").groupBy("root", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
        grown = grown.union(level)
    first = grown.groupBy("root", "node").agg(F.min(F.struct("depth", (-F.col("score")).alias("s"))).alias("f")).select("root", "node", "f.depth", (-F.col("f.s")).alias("score"))
    order = Window.partitionBy("root").orderBy("depth", F.desc("score"), "node")
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
