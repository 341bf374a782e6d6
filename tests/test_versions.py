"""Versions of several tables: all of one or all of the one before."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.sources.versions import Conflict, Store, Version, scope_space, vacuum_report


@pytest.fixture
def store(spark):
    return Store(spark, "file://" + tempfile.mkdtemp(prefix="cairn-store-"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, scope string, body string").repartition(2, "scope")


def ids(f):
    return sorted(r["id"] for r in f.collect())


def test_commit_append_restore(spark, store):
    assert store.version() is None and store.numbers() == []
    assert store.commit({"a": frame(spark, (1, "x", "one")), "b": frame(spark, (7, "y", "seven"))}) == 1
    assert store.commit({"a": frame(spark, (2, "x", "two"))}, append=True) == 2
    assert store.commit({"b": frame(spark, (8, "y", "eight"))}) == 3
    assert ids(store.read("a")) == [1, 2] and ids(store.read("b")) == [8]
    assert ids(store.read("a", 1)) == [1] and ids(store.read("b", 2)) == [7]
    assert store.restore(1) == 4
    assert ids(store.read("a")) == [1] and ids(store.read("b")) == [7]
    assert store.commit({}, drop=("b",)) == 5
    with pytest.raises(KeyError):
        store.read("b")
    with pytest.raises(ValueError):
        store.commit({"a": frame(spark, (3, "x", "three")).drop("body")}, append=True)


def test_writer_that_dies_half_way(spark, store):
    """One of two tables is written when the writer dies: readers see the version before, whole."""
    store.commit({"a": frame(spark, (1, "x", "one")), "b": frame(spark, (1, "x", "one"))})
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        store.commit({"a": frame(spark, (2, "x", "two")), "b": frame(spark, (2, "x", "two")).withColumn("body", boom("body"))})
    again = Store(spark, store.root)
    assert again.numbers() == [1] and ids(again.read("a")) == [1] and ids(again.read("b")) == [1]
    assert again.space()["dead_bytes"] > 0
    assert again.vacuum()["freed_bytes"] > 0 and again.space()["dead_bytes"] == 0
    assert ids(again.read("a")) == [1]


def test_manifest_written_but_not_named(spark, store):
    store.commit({"a": frame(spark, (1, "x", "one"))})
    with open(store.root.removeprefix("file://") + "/versions/.half", "w") as f:
        f.write('{"tables": {')
    assert store.numbers() == [1] and ids(store.read("a")) == [1]


def test_two_writers_from_one_version(spark, store):
    store.commit({"a": frame(spark, (1, "x", "one"))})
    store.commit({"a": frame(spark, (2, "x", "two"))}, base=1)
    with pytest.raises(Conflict):
        store.commit({"a": frame(spark, (3, "x", "three"))}, base=1)
    with pytest.raises(Conflict):
        store._claim(Version(2))
    assert ids(store.read("a")) == [2]
    assert [n for n in os.listdir(store.root.removeprefix("file://") + "/versions") if n.endswith(".json")] and store.numbers() == [1, 2]


def test_vacuum_keeps_what_versions_name(spark, store):
    for k in range(4):
        store.commit({"a": frame(spark, (k, "x", "text"))}, append=k == 2)
    store.vacuum(keep=2)
    assert store.numbers() == [3, 4] and ids(store.read("a", 3)) == [1, 2] and ids(store.read("a", 4)) == [3]
    with pytest.raises(ValueError):
        store.vacuum(0)


def sizes(store, name):
    root = f"{store.root.removeprefix('file://')}/data/{name}"
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def test_vacuum_report_equals_the_listing(spark, store):
    rows = [(i, f"s{i % 3}", chr(97 + i % 26) * (10 + 7 * i % 400)) for i in range(300)] + [(900, None, "none"), (901, "s1", None)]
    store.commit({"evidence": frame(spark, *rows)})
    gone = spark.createDataFrame([("s1",), ("s1",), ("unknown",)], "scope_id string")
    before = sizes(store, "evidence")
    shares = {r["scope_id"]: r for r in scope_space(store, "evidence", "scope", F.length("body"), gone).collect()}
    assert {k: r["state"] for k, r in shares.items()} == {"s0": "live", "s1": "forgotten", "s2": "live", None: "live"}
    assert abs(sum(r["file_bytes"] for r in shares.values()) - before) <= len(shares)
    assert {k: r["payload_bytes"] for k, r in shares.items()} == {s: sum(len(b or "") for _, x, b in rows if x == s) for s in ("s0", "s1", "s2", None)}
    told = vacuum_report(store, "evidence", "scope", F.length("body"), gone)
    assert told["file_bytes_before"] == before and told["file_bytes_after"] == sizes(store, "evidence") and told["freed_bytes"] == before
    assert told["forgotten_rows"] == sum(s == "s1" for _, s, _ in rows) and told["live_rows"] == len(rows) - told["forgotten_rows"]
    assert ids(store.read("evidence")) == sorted(i for i, s, _ in rows if s != "s1")
    nothing = vacuum_report(store, "evidence", "scope", F.length("body"), gone)
    assert nothing["forgotten_rows"] == 0 and nothing["forgotten_bytes"] == 0
