"""Working memory, schedules, change logs and the pipeline, against plain replays."""

from __future__ import annotations

import json
import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.sources.versions import Store
from cairn.streaming import changelog as cl, schedule as sc, working as wk

# ---- working memory


def plain_window(entries, capacity):
    """(id, relevance, at, ttl) in order; a list that is looked through for each push."""
    held, out = [], []
    for n, (i, r, t, ttl) in enumerate(entries):
        left = [(h[0], "expired") for h in sorted(held, key=lambda h: (h[3], h[4])) if h[3] <= t]
        held = [h for h in held if h[3] > t]
        while len(held) >= capacity:
            low = min(held, key=lambda h: (-math.inf if h[1] is None else math.inf if math.isnan(h[1]) else h[1], h[2], h[4]))
            held.remove(low)
            left.append((low[0], "crowded_out"))
        held.append((i, r, t, t + max(0, ttl or 0), n))
        out.append((i, [h[0] for h in held if t < h[3]], left))
    return out


def entries(seed, n):
    r, t, out = random.Random(seed), 0.0, []
    for k in range(n):
        t += r.choice([0.0, 1.0, 5.0])
        out.append((f"e{k:03d}", r.choice([None, 0.1, 0.5, 0.5, r.random(), math.nan]), t, r.choice([None, 0.0, 3.0, 10.0, 40.0])))
    return out


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_window_equals_a_list(capacity):
    rows = entries(capacity, 300)
    window = wk.Window(capacity)
    for (i, r, t, ttl), (_, context, left) in zip(rows, plain_window(rows, capacity), strict=True):
        assert window.push(i, r, t, ttl) == left
        assert window.live(t) == context
        assert len(window.entries) <= capacity and len(window._low) <= 4 * capacity + 17


def test_new_entry_is_held_whatever_its_relevance():
    window = wk.Window(2)
    window.push("a", 0.9, 0, 100), window.push("b", 0.8, 1, 100)
    assert window.push("c", 0.1, 2, 100) == [("b", "crowded_out")] and window.live(2) == ["a", "c"]


def by_scope():
    return {s: entries(k, 60) for k, s in enumerate(["x", "y", None])}


def test_replay_and_stream_equal_a_plain_replay(spark):
    rows = [(s, *e) for s, own in by_scope().items() for e in own]
    frame = spark.createDataFrame(rows, "scope string, id string, relevance double, at double, ttl double")
    # in order of time and id, as the plain one
    want = {(s, i): (c, left) for s, own in by_scope().items() for i, c, left in plain_window(sorted(own, key=lambda e: (e[2], e[0])), 4)}
    got = {(r["scope"], r["id"]): (list(r["context"]), [tuple(x) for x in r["left"]]) for r in wk.replay(frame.repartition(5), "scope", "id", "at", "relevance", 4, "ttl").collect()}
    assert got == want
    last = {s: max(own, key=lambda e: (e[2], e[0]))[0] for s, own in by_scope().items()}
    assert {(r["scope"], r["id"]) for r in wk.replay(frame, "scope", "id", "at", "relevance", 4, "ttl", final=True).collect()} == set(last.items())
    at = tempfile.mkdtemp()
    for k in range(3):
        frame.where((F.col("at") >= 60 * k) & ((F.col("at") < 60 * (k + 1)) | F.lit(k == 2))).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = wk.stream(stream, "scope", "id", "at", "relevance", 4, "ttl")
    out.writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["scope"], r["id"]): (list(r["context"]), [tuple(x) for x in r["left"]]) for r in spark.table("windows").collect()} == want


def test_empty_replay(spark):
    assert wk.replay(spark.createDataFrame([], "scope string, id string, relevance double, at double"), "scope", "id", "at", "relevance", 4, 5.0).count() == 0


# ---- schedules

COMMANDS = [("a", "schedule", 1000, 0), ("b", "schedule", 400, 100), ("c", "schedule", 0, 0), ("a", "failed", None, 1500), ("a", "failed", None, 3600), ("a", "done", None, 9000), ("b", "unschedule", None, 2000), ("d", "done", None, 5), ("e", "schedule", 500, 10), ("e", "schedule", 2000, 700), ("a", "dance", None, 10)]


def test_missed_ticks_are_one():
    plan = sc.Plan(1000, 1000)
    assert plan.tick(1000, 60_000) == (1000, 0, 0) and plan.due == 2000
    assert plan.tick(5700, 60_000) == (2000, 3, 0) and plan.due == 6000


def test_back_off_doubles_up_to_the_longest():
    plan = sc.Plan(1000, 1000)
    delays = []
    for _ in range(8):
        plan.failed(0, 20_000)
        delays.append(plan.due)
    assert delays == [2000, 4000, 8000, 16000, 20000, 20000, 20000, 20000]
    plan.done(50)
    assert plan.due == 1050 and plan.failures == 0
    plan.done(500)
    assert plan.due == 1050
    slow = sc.Plan(30_000, 30_000)
    slow.failed(0, 20_000)
    assert slow.due == 30_000  # never sooner than its own interval


def test_plain_ticks_with_a_manual_clock():
    got = sc.plain_ticks(COMMANDS, [1000, 2000, 2500, 4000, 12_000], 60_000)
    assert got == [("a", 1000, 1000, 0, 0), ("b", 500, 1000, 1, 0), ("e", 2700, 4000, 0, 0), ("a", 10000, 12000, 2, 0), ("e", 4700, 12000, 3, 0)]


def test_event_time_ticks(spark):
    """The watermark is the clock: ticks come when it has passed them, with those that were missed."""
    sc.use_timers(spark)
    at = tempfile.mkdtemp()
    schema = "instance string, kind string, interval bigint, at bigint"
    base = 1_700_000_000_000
    batches = [[("a", "schedule", 1000, 0), ("b", "schedule", 5000, 0)], [("clock", "none", None, 1500)], [("clock", "none", None, 4700)], [("b", "unschedule", None, 4800), ("clock", "none", None, 9000)], [("clock", "none", None, 9001)]]
    for k, rows in enumerate(batches):
        rows = [(i, kind, interval, base + t) for i, kind, interval, t in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{at}/in")
        now = 1_700_000_000 + k
        for name in os.listdir(f"{at}/in"):
            if name.startswith("part") and os.path.getmtime(f"{at}/in/{name}") > 1_700_001_000:
                os.utime(f"{at}/in/{name}", (now, now))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{at}/in").withColumn("moment", F.timestamp_millis("at")).withWatermark("moment", "0 seconds")
    q = sc.ticks(stream, time_mode="EventTime").writeStream.format("memory").queryName("ticks").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r["instance"], r["due"] - base, r["at"] - base, r["missed"]) for r in spark.table("ticks").collect())
    # b was unscheduled by a command that came before its time
    assert got == [("a", 1000, 1500, 0), ("a", 2000, 4700, 2), ("a", 5000, 9000, 4)]


def test_processing_time_ticks(spark):
    sc.use_timers(spark)
    at = tempfile.mkdtemp()
    schema = "instance string, kind string, interval bigint, at bigint"
    import time

    spark.createDataFrame([("a", "schedule", 500, int(time.time() * 1000) - 3000), (None, "schedule", 1, 0)], schema).coalesce(1).write.json(f"{at}/in")
    q = sc.ticks(spark.readStream.schema(schema).json(f"{at}/in")).writeStream.format("memory").queryName("real_ticks").option("checkpointLocation", f"{at}/c").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            rows = spark.table("real_ticks").collect()
            if len(rows) >= 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert len(rows) >= 3 and rows[0]["missed"] >= 4 and all(r["at"] >= r["due"] for r in rows)
    assert all((b["due"] - a["due"]) % 500 == 0 for a, b in zip(rows, rows[1:], strict=False))


# ---- change logs


def change(k, kind="created", doc=None, scope="s0", **more):
    return json.dumps({"kind": kind, "document_id": doc or f"d{k}", "scope_id": scope, "occurred_at": k, "title": "t" * (k % 7) + "é", **more}, ensure_ascii=False)


def append(path, log, *lines):
    with open(f"{path}/{log}", "a", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))


@pytest.mark.parametrize("stretch", [7, 64, 100_000])
def test_stretches_have_each_line_once(stretch):
    path = tempfile.mkdtemp()
    rows = [change(k) for k in range(40)] + ["", "x", "y" * 300]
    append(path, "a", *rows)
    end = os.path.getsize(f"{path}/a")
    parts = cl.ChangelogStream(path, stretch, 1 << 40).partitions({}, {"a": end})
    got = [line.decode() for p in parts for _, line in cl.lines(path, p)]
    assert got == rows
    places = [at for p in parts for at, _ in cl.lines(path, p)]
    assert places == [sum(len(r.encode()) + 1 for r in rows[:i]) for i in range(len(rows))]


def test_half_written_lines_wait():
    path = tempfile.mkdtemp()
    append(path, "a", "one", "two")
    with open(f"{path}/a", "a") as f:
        f.write("three, not yet")
    stream = cl.ChangelogStream(path, 1 << 20, 1 << 40)
    assert stream.latestOffset() == {"a": 8}
    bounded = cl.ChangelogStream(path, 1 << 20, 5)
    assert bounded.latestOffset() == {"a": 4} and bounded.latestOffset() == {"a": 8} and bounded.latestOffset() == {"a": 8}
    long = cl.ChangelogStream(path, 1 << 20, 2)
    assert long.latestOffset() == {"a": 4}  # a line longer than a batch is a batch


def test_batch_read(spark):
    cl.register(spark)
    path = tempfile.mkdtemp()
    append(path, "a", change(1), "no json", "[1]", '{"kind": 5, "occurred_at": "x", "document_id": null}')
    append(path, "b", change(2, "deleted"))
    rows = spark.read.format("cairn_changelog").option("path", path).option("stretch", 10).load().orderBy("log", "place").collect()
    assert [(r["log"], r["kind"], r["document_id"], r["occurred_at"]) for r in rows] == [("a", "created", "d1", 1), ("a", None, None, None), ("a", None, None, None), ("a", None, None, None), ("b", "deleted", "d2", 2)]


def fetcher():
    def fetch(rows):
        if any(r["document_id"] == "d13" for r in rows):
            raise RuntimeError("source is down")
        return [None if r["document_id"] == "d5" else "" if r["document_id"] == "d6" else f"body of {r['document_id']}, {r['title']}" for r in rows]

    return fetch


def test_pipeline_resumes_after_a_kill(spark):
    cl.register(spark)
    path, at = tempfile.mkdtemp(), tempfile.mkdtemp()
    store = Store(spark, f"file://{at}/store")
    for log in ("a", "b", "c"):
        append(path, log, *[change(k, scope=f"s{k % 3}") for k in range(20) if k % 3 == "abc".index(log)])
    append(path, "a", change(100, "updated", "d3", "s0"), change(101, "deleted", "d0", "s0"), change(102, "moved", "d1"), change(103, "permission_changed", "d2", "s2"), "junk")
    stream = lambda: spark.readStream.format("cairn_changelog").option("path", path).option("stretch", 64).load()
    died = []

    def dies(frame, number):
        cl.ingest(store, frame, number, fetcher)
        died.append(number)
        raise RuntimeError("killed behind the commit of the store, before that of the stream")

    q = stream().writeStream.foreachBatch(dies).option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    with pytest.raises(Exception):
        q.awaitTermination(120)
    assert died == [0]
    cl.run(stream(), store, fetcher, f"{at}/c").awaitTermination(120)
    runs = store.read(cl.RUNS).collect()
    assert [(r["batch"], r["events"], r["malformed"], r["passed_over"], r["fetched"], r["ingested"], r["skipped"]) for r in runs] == [(0, 25, 1, 2, 19, 16, 3)]
    append(path, "b", change(200, "updated", "d5", "s2"), change(201, "created", "d77", "s9"))
    append(path, "new", change(202, "deleted", "d77", "s9"), change(203, "created", "d78", "s1"))
    cl.run(stream(), store, fetcher, f"{at}/c").awaitTermination(120)
    have = {(r["scope_id"], r["document_id"]): r["title"] for r in cl.current(store).collect()}
    want = {(f"s{k % 3}", f"d{k}") for k in range(20)} - {("s0", "d0"), ("s2", "d5"), ("s0", "d6"), ("s1", "d13")} | {("s1", "d78")}
    assert set(have) == want and have["s0", "d3"] == "t" * (100 % 7) + "é"
    triggers = sorted((r["batch"], r["scope_id"], r["documents"]) for r in store.read(cl.TRIGGERS).collect())
    assert triggers == [(0, "s0", 5), (0, "s1", 6), (0, "s2", 5), (1, "s1", 1)]
    cl.run(stream(), store, fetcher, f"{at}/c").awaitTermination(120)
    assert len(store.read(cl.RUNS).collect()) == 2
