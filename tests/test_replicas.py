"""Replicas under lost, repeated and reordered deltas; pairs by a predicate in blocks."""

from __future__ import annotations

import itertools
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.operators import pairing, replicas as rp
from cairn.sources.versions import Store


def store(spark):
    return Store(spark, "file://" + tempfile.mkdtemp(prefix="cairn-replica-"))


def ops(spark, rows):
    return spark.createDataFrame([(r, s, "add", f"v{s}", f"{r}{s}", None) for r, s in rows], rp.COLUMNS)


def plain_vector(seqs):
    have, upto = set(s for s in seqs if s >= 1), 0
    while upto + 1 in have:
        upto += 1
    beyond = []
    for s in sorted(x for x in have if x > upto):
        if beyond and beyond[-1][1] == s - 1:
            beyond[-1][1] = s
        else:
            beyond.append([s, s])
    return upto, [tuple(b) for b in beyond]


@pytest.mark.parametrize("size", [1, 4, 1 << 16])
def test_vector_equals_a_plain_one(spark, size):
    r = random.Random(size)
    seqs = {"a": list(range(1, 30)), "b": [2, 3, 9], "c": r.sample(range(1, 60), 35), "d": [1], "e": [0, -3], "f": [1, 2, 2, 3, 5, 5]}
    frame = ops(spark, [(k, s) for k, own in seqs.items() for s in own] + [(None, 4)])
    got = {v["replica"]: (v["upto"], [tuple(x) for x in v["beyond"]]) for v in rp.vector(frame, size).collect()}
    assert got == {k: plain_vector(own) for k, own in seqs.items() if k != "e"}


def test_delta_is_what_a_vector_lacks(spark):
    all_ = [(k, s) for k in "abc" for s in range(1, 12)]
    have = [("a", s) for s in (1, 2, 3, 6, 7, 11)] + [("b", 5)]
    missing = rp.delta(ops(spark, all_), rp.vector(ops(spark, have)))
    assert sorted((r["replica"], r["seq"]) for r in missing.collect()) == sorted(set(all_) - set(have))
    lag = {r["replica"]: (r["ahead"], r["behind"]) for r in rp.lag(rp.vector(ops(spark, all_)), rp.vector(ops(spark, have))).collect()}
    assert lag == {"a": (8, 0), "b": (11, 0), "c": (11, 0)}
    assert rp.vector(ops(spark, [])).count() == 0 and rp.delta(ops(spark, all_), rp.vector(ops(spark, []))).count() == len(all_)


class Unreliable:
    """A transport that loses pushes (and says so, or not), and gives pages again or in another order."""

    def __init__(self, relay, seed):
        self.relay, self.r = relay, random.Random(seed)

    def push(self, topic, frame):
        luck = self.r.random()
        if luck < 0.3:
            raise ConnectionError("lost on the way")
        at = self.relay.push(topic, frame)
        if luck < 0.6:
            raise ConnectionError("arrived, but the answer was lost")
        return at

    def pull(self, topic, since):
        if self.r.random() < 0.3:
            raise ConnectionError("no answer")
        frame, at = self.relay.pull(topic, max(0, since - self.r.choice([0, 0, 1, 2])))
        if frame is not None and self.r.random() < 0.5:
            frame = frame.union(frame).orderBy(F.rand(3))
        return frame, at


def test_three_replicas_converge(spark):
    relay = rp.Relay(store(spark))
    members = [rp.Replica(store(spark), name) for name in "abc"]
    r = random.Random(5)
    for k, m in enumerate(members):
        rows = [("add", f"x{r.randrange(12)}", f"{m.name}{i}", None, i) for i in range(6)] + [("remove", None, None, f"{m.name}{i}", 100 + i) for i in (1, 4)]
        assert m.record(spark.createDataFrame(rows, "kind string, value string, tag string, observed_tag string, at int"), "at") == len(rows)
        assert m.last() == 8
        lossy = Unreliable(relay, k)
        for _ in range(12):
            try:
                m.sync(lossy, "t")
            except ConnectionError:
                continue
    members[0].record(spark.createDataFrame([("remove", None, None, "b0", 1)], "kind string, value string, tag string, observed_tag string, at int"), "at")
    for m in [*members, *members]:
        m.sync(relay, "t")
    logs = [sorted((o["replica"], o["seq"]) for o in m.ops().collect()) for m in members]
    assert logs[0] == logs[1] == logs[2] and len(logs[0]) == 25 == len(set(logs[0]))
    sets = [sorted(x["value"] for x in m.elements().collect()) for m in members]
    assert sets[0] == sets[1] == sets[2] and sets[0]
    assert all(m.cursor("t", "pushed") == m.last() for m in members)
    assert members[0].sync(relay, "t") == (0, 0)


def test_replicas_meet_by_vectors_alone(spark):
    a, b = rp.Replica(store(spark), "a"), rp.Replica(store(spark), "b")
    a.absorb(ops(spark, [("a", s) for s in range(1, 9)] + [("c", 2)]))
    b.absorb(ops(spark, [("b", s) for s in range(1, 4)] + [("a", 5), ("c", 1)]))
    assert b.absorb(a.delta_for(b.vector())) == 8
    assert b.absorb(a.ops()) == 0
    assert a.absorb(b.delta_for(a.vector())) == 4
    assert sorted((o["replica"], o["seq"]) for o in a.ops().collect()) == sorted((o["replica"], o["seq"]) for o in b.ops().collect())


def test_acknowledged_segments_go(spark):
    relay = rp.Relay(store(spark))
    for k in range(1, 5):
        assert relay.push("t", ops(spark, [("a", k)])) == k
    assert relay.trim("t", [2, 3]) == 2
    frame, at = relay.pull("t", 2)
    assert at == 4 and sorted(r["seq"] for r in frame.collect()) == [3, 4]
    with pytest.raises(LookupError):
        relay.pull("t", 1)
    assert relay.push("t", ops(spark, [("a", 5)])) == 5 and relay.pull("t", 5) == (None, 5)
    assert relay.pull("other", 0) == (None, 0)


# ---- pairs


def opposes():
    def judge(pairs):
        return [(x["n"] is not None and y["n"] is not None) and (x["n"] + y["n"]) % 3 == 0 for x, y in pairs]

    return judge


@pytest.mark.parametrize("piece", [2, 7, 1000])
def test_pairs_equal_all_pairs(spark, piece):
    r = random.Random(piece)
    rows = [(i, r.choice(["x", "y", "hot", "hot", "hot", None]), r.choice([None, *range(9)])) for i in range(70)]
    rows += [rows[3], (None, "hot", 1), (rows[9][0], "hot", 3)]
    frame = spark.createDataFrame(rows, "id int, scope string, n int")
    want = set()
    for (i, s, n), (j, t, m) in itertools.combinations(set(rows), 2):
        if s is not None and s == t and None not in (i, j, n, m) and i != j and (n + m) % 3 == 0:
            want.add((min(i, j), max(i, j)))
    got = [(p["left_id"], p["right_id"]) for p in pairing.matching_pairs(frame, "id", ["scope"], ["n"], opposes, piece, batch=5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_block_is_many_tiles(spark):
    frame = spark.range(400).select(F.col("id").alias("_id"), F.lit("hot").alias("_key0"))
    sizes = [r["count"] for r in pairing.tiles(frame, "_id", ["_key0"], 50).groupBy("_a", "_b").count().collect()]
    assert len(sizes) == 36 and max(sizes) < 4 * 50
    assert pairing.matching_pairs(spark.createDataFrame([], "id int, scope string, n int"), "id", ["scope"], ["n"], opposes).count() == 0
