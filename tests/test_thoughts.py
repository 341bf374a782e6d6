"""Searches over thoughts against one queue in plain Python, and batches of answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import callbacks as cb, thoughts as th
from cairn.plans.durable import Scratch


def plain(plan, kids, order, budget):
    """One search, a thought at a time. plan: (place, node, confidence); kids: node -> [(child, confidence, kind)]."""
    thoughts = [[n, None if p == 0 else 0, 0 if p == 0 else 1, c, "question", None] for p, n, c in sorted(plan)]
    frontier, turn = list(range(len(thoughts))), 0
    sure = lambda i: float("-inf") if thoughts[i][3] is None else thoughts[i][3]
    while frontier:
        if order == "breadth_first":
            i = frontier[0]
        elif order == "depth_first":
            i = frontier[-1]
        elif order == "best_first":
            i = max(frontier, key=lambda j: (sure(j), -j))
        else:
            least = min(thoughts[j][2] for j in frontier)
            i = max((j for j in frontier if thoughts[j][2] == least), key=lambda j: (sure(j), -j))
        frontier.remove(i)
        if thoughts[i][2] >= budget.depth:
            continue
        if len(thoughts) >= budget.nodes:
            return thoughts, True
        thoughts[i][5], turn = turn, turn + 1
        for child, c, kind in kids.get(thoughts[i][0], [])[: budget.branches]:
            if len(thoughts) >= budget.nodes:
                return thoughts, True
            thoughts.append([child, i, thoughts[i][2] + 1, c, kind, None])
            frontier.append(len(thoughts) - 1)
    return thoughts, False


def graph(seed=3, n=40):
    r = random.Random(seed)
    kids = {}
    for a in range(n):
        found = [(r.randrange(n), r.choice([None, 0.1, 0.5, 0.5, 0.9, r.random()]), r.choice(["evidence", "conclusion"])) for _ in range(r.choice([0, 1, 3, 7]))]
        kids[a] = sorted(set(found), key=lambda x: (x[1] is None, -(x[1] or 0), x[0], x[2]))
    return kids


@pytest.mark.parametrize("order", th.ORDERS)
@pytest.mark.parametrize("budget", [th.Budget(4, 3, 25), th.Budget(2, 2, 100), th.Budget(6, 1, 5), th.Budget(0, 3, 9), th.Budget(3, 9, 4)])
def test_search_equals_one_queue(spark, order, budget):
    kids = graph()
    steps = spark.createDataFrame([(a, b, c, k) for a, found in kids.items() for b, c, k in found], "src int, dst int, confidence double, kind string")
    roots = spark.createDataFrame([(r, r) for r in range(0, 40, 3)], "root int, node int")
    subs = spark.createDataFrame([(0, 1, 7), (0, 2, 9), (3, 1, 3), (99, 1, 1)], "root int, place int, node int")
    plans = th.plan(roots, subs)
    found = th.search(plans, th.by_table(steps, budget.branches), Scratch(spark, "t"), order, budget)
    got = {}
    for r in found.orderBy("root", "seq").collect():
        got.setdefault(r["root"], []).append(([r["node"], r["parent"], r["depth"], r["confidence"], r["kind"], r["turn"]], r["exhausted"]))
    by_root = {}
    for r in plans.collect():
        by_root.setdefault(r["root"], []).append((r["place"], r["node"], r["confidence"]))
    assert set(got) == set(range(0, 40, 3))
    for root, rows in got.items():
        want, full = plain(by_root[root], kids, order, budget)
        assert [x for x, _ in rows] == want
        assert {e for _, e in rows} == {full}


def test_odd_plans(spark):
    steps = spark.createDataFrame([], "src string, dst string, confidence double, kind string")
    plans = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 0, "x", 1.0), ("b", 1, "y", 0.9), ("c", 0, None, None)], "root string, place int, node string, confidence double")
    rows = th.search(plans, th.by_table(steps, 2), Scratch(spark, "t")).orderBy("root").collect()
    assert [(r["root"], r["seq"], r["node"], r["turn"], r["exhausted"]) for r in rows] == [("a", 0, "x", 0, False), ("c", 0, None, 0, False)]
    assert th.search(plans.where("false"), th.by_table(steps, 2), Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        th.search(plans, th.by_table(steps, 2), Scratch(spark, "t"), "sideways")


@pytest.mark.parametrize("order, most", [("breadth_first", 5), ("iterative", 5), ("depth_first", 8), ("best_first", 8)])
def test_rounds_are_fewer_than_thoughts(spark, order, most):
    asked = []
    steps = spark.createDataFrame([(a, 2 * a + k, 0.5, "evidence") for a in range(1, 60) for k in (0, 1)], "src int, dst int, confidence double, kind string")
    table = th.by_table(steps, 2)

    def expand(rows):
        asked.append(rows.count())
        return table(rows)

    plans = th.plan(spark.createDataFrame([(r, r) for r in (1, 1, 2, 3)], "root int, node int"))
    found = th.search(plans, expand, Scratch(spark, "t"), order, th.Budget(4, 2, 100))
    assert found.where("root = 1").count() == 31 and len(asked) <= most


def test_paths(spark):
    rows = [("r", 0, "q", None, 0, 1.0, "question"), ("r", 1, "a", 0, 1, 0.5, "evidence"), ("r", 2, "b", 0, 1, 0.8, "hypothesis"), ("r", 3, "c", 2, 2, 0.9, "conclusion")]
    thoughts = spark.createDataFrame(rows, "root string, seq int, node string, parent int, depth int, confidence double, kind string")
    got = sorted((r["leaf"], list(r["seqs"]), list(r["confidences"]), r["concludes"]) for r in th.paths(thoughts, th.Budget(), Scratch(spark, "t")).collect())
    assert got == [(1, [0, 1], [1.0, 0.5], False), (3, [0, 2, 3], [1.0, 0.8, 0.9], True)]


def test_expander_that_fails_at_times(spark):
    """A model gives children by arithmetic, fails on batches with a bad row, and nobody is left without an answer."""

    def factory():
        def model(rows):
            if any(r["node"] % 5 == 4 for r in rows):
                raise RuntimeError("overloaded")
            return [[{"node": r["node"] + k, "confidence": 0.5, "kind": "evidence"} for k in (1, 10)] for r in rows]

        return model

    answer = "children array<struct<node:int,confidence:double,kind:string>>"

    def expand(asked):
        got = cb.answered(asked.select("root", "seq", "node"), ["node"], factory, answer, lambda row: [{"node": 1000, "confidence": 0.0, "kind": "fallback"}], attempts=2)
        return got.select("root", "seq", F.posexplode("children").alias("place", "c")).select("root", "seq", "place", "c.*")

    plans = th.plan(spark.createDataFrame([(r, r) for r in range(6)], "root int, node int"))
    found = th.search(plans, expand, Scratch(spark, "t"), "iterative", th.Budget(2, 2, 50)).collect()
    kids = {n: [(1000, 0.0, "fallback")] if n % 5 == 4 else [(n + 1, 0.5, "evidence"), (n + 10, 0.5, "evidence")] for n in range(2000)}
    for root in range(6):
        want, _ = plain([(0, root, 1.0)], kids, "iterative", th.Budget(2, 2, 50))
        assert [[r["node"], r["parent"], r["depth"], r["confidence"], r["kind"], r["turn"]] for r in sorted((r for r in found if r["root"] == root), key=lambda r: r["seq"])] == want


def test_ask_retries_cuts_and_falls_back():
    calls = []

    def model(rows):
        calls.append(len(rows))
        if any(r["x"] == 3 for r in rows):
            raise RuntimeError
        return [r["x"] * 2 for r in rows]

    got = cb.ask(model, [{"x": x} for x in range(6)], lambda r: -1, attempts=2)
    assert [a for a, _ in got] == [0, 2, 4, -1, 8, 10]
    assert [s for _, s in got].count("fallback") == 1 and got[3][1] == "fallback"
    turns = iter([RuntimeError, None])

    def shaky(rows):
        if next(turns, None) is RuntimeError:
            raise RuntimeError
        return [1] * len(rows)

    assert cb.ask(shaky, [{}, {}], lambda r: 0, attempts=2) == [(1, "retry"), (1, "retry")]
    assert cb.ask(lambda rows: [1], [{}, {}], lambda r: 0, attempts=1) == [(1, "retry"), (1, "retry")]  # one answer for two rows is none

    def refuses(rows):
        calls.append("refused")
        raise cb.Refused

    calls.clear()
    assert cb.ask(refuses, [{}], lambda r: 0, attempts=5) == [(0, "fallback")] and calls == ["refused"]


def test_answered_keeps_all_rows(spark):
    frame = spark.createDataFrame([(1, "a", [1]), (2, None, None), (2, None, None)], "id int, text string, extra array<int>")
    got = cb.answered(frame, ["text"], lambda: lambda rows: [(r["text"] or "") + "!" for r in rows], "said string", lambda r: "", batch=2)
    assert sorted((r["id"], r["said"], r["answered_by"]) for r in got.collect()) == [(1, "a!", "model"), (2, "!", "model"), (2, "!", "model")]
    assert cb.answered(frame.where("false"), ["text"], lambda: lambda rows: [], "said string", lambda r: "").count() == 0
    with pytest.raises(ValueError):
        cb.answered(frame, ["text"], lambda: None, "extra string", lambda r: "")
