"""Several tables as one: versions that are committed as a whole, restored, and cleaned up.

A store is a folder with ``data/<table>/<id>``, where writers put Parquet files, and ``versions``,
with one small manifest for each version: which folders make up each table. A writer first
writes all its data and then gives its manifest its name, which the file system does at once
and refuses if the name is taken. So a reader sees the whole of a version or the one before;
a writer that dies half way leaves files that no version names, and of two writers from one
version the second one is told.

Data are never changed in place. ``vacuum`` deletes what the versions that are kept don't name.
All folders go through Hadoop's file systems: a store may be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cairn.plans.durable import Scratch, setting

#: A write's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(Exception):
    """Another writer has committed in the meantime."""


def _nullable(schema: str) -> str:
    """A schema as files have it: any value may be null."""
    for name in ("nullable", "containsNull", "valueContainsNull"):
        schema = schema.replace(f'"{name}":false', f'"{name}":true')
    return schema


@dataclass
class Version:
    """tables: for each table, the folders that it is made of and the schema of its rows."""

    number: int
    tables: dict[str, dict] = field(default_factory=dict)
    note: str = ""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.scratch = Scratch(spark, "store")

    # ---- files

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _children(self, at: str) -> list:
        fs, path = self._fs(), self._path(at)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def files(self, at: str) -> dict[str, int]:
        """Bytes of each data file below a folder."""
        fs, path, out = self._fs(), self._path(at), {}
        if fs.exists(path):
            found = fs.listFiles(path, True)
            while found.hasNext():
                f = found.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out[f.getPath().toString()] = f.getLen()
        return out

    def _claim(self, version: Version) -> None:
        """Name a manifest: the one step that makes a version."""
        folder = f"{self.root}/versions"
        temp, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version.number:012d}.json")
        fs = self._fs()
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps({"tables": version.tables, "note": version.note}).encode()))
        finally:
            out.close()
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self._conf)
            none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(temp, final, none)
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version.number} is there already") from None
            raise

    # ---- versions

    def numbers(self) -> list[int]:
        """All versions, oldest first."""
        names = [s.getPath().getName() for s in self._children(f"{self.root}/versions")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the latest; None if there is none."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            return None
        number = known[-1] if number is None else number
        text = self.spark.read.text(f"{self.root}/versions/{number:012d}.json", wholetext=True).first()[0]
        return Version(number, **json.loads(text))

    def _write(self, name: str, frames: list[DataFrame], partition_by: list[str]) -> dict:
        folders = [f"data/{name}/{uuid.uuid4().hex}" for _ in frames]
        for frame, at in zip(frames, folders, strict=True):
            with setting(self.spark, _CLEANUP, "true"):
                frame.write.partitionBy(*partition_by).parquet(f"{self.root}/{at}")
        # partition columns come last when they are read
        order = [c for c in frames[0].columns if c not in partition_by] + partition_by
        return {"folders": folders, "schema": _nullable(frames[0].select(*order).schema.json()), "partition_by": partition_by}

    def commit(self, frames: dict[str, DataFrame | list[DataFrame] | Callable[[], DataFrame]], append: bool = False, base: int | None = None, partition_by: dict[str, list[str]] | None = None, note: str = "", drop: tuple[str, ...] = ()) -> int:
        """A new version: that of ``base`` (by default the latest) with ``frames`` in place of its tables, or behind them.

        A table may come in parts of one schema, which are written one after the other: what is shuffled
        for one is gone before the next. Raises ``Conflict`` if another version has come after ``base``; what was written stays until the next vacuum.
        """
        before = self.version(base) or Version(0)
        latest = (self.numbers() or [0])[-1]
        if before.number != latest:
            raise Conflict(f"version {latest} has come after {before.number}")
        # one after the other: a frame may be a function, which is called once those before it are written
        parts = lambda frame: frame if isinstance(frame, list) else [frame() if callable(frame) else frame]
        written = {name: self._write(name, parts(frame), (partition_by or {}).get(name, [])) for name, frame in frames.items()}
        tables = {n: t for n, t in before.tables.items() if n not in drop}
        for name, new in written.items():
            old = tables.get(name) if append else None
            if old and json.loads(old["schema"]) != json.loads(new["schema"]):
                raise ValueError(f"{name} has another schema")
            tables[name] = (old or {}) | {"folders": (old["folders"] if old else []) + new["folders"], "schema": new["schema"], "partition_by": new["partition_by"]}
        self._claim(Version(before.number + 1, tables, note))
        return before.number + 1

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a version."""
        found = self.version(number)
        if found is None or name not in found.tables:
            raise KeyError(name)
        return self._load(found.tables[name], found.tables[name]["folders"])

    def _load(self, table: dict, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(table["schema"])))
        if not table.get("partition_by"):
            return reader.parquet(*[f"{self.root}/{f}" for f in folders])
        # each folder has partitions of its own
        return reduce(DataFrame.unionByName, [reader.parquet(f"{self.root}/{f}") for f in folders])

    def read_folders(self, name: str, folders: list[str]) -> DataFrame:
        """Some of the folders that make up a table of the latest version."""
        return self._load(self.version().tables[name], folders)

    def forget_first(self, name: str, count: int) -> int:
        """A version without a table's first folders, counted from its very first; how many have gone by now."""
        before = self.version()
        table = before.tables[name]
        gone = table.get("gone", 0)
        drop = min(max(count - gone, 0), len(table["folders"]) - 1)  # one stays, for the schema
        if drop:
            tables = before.tables | {name: table | {"folders": table["folders"][drop:], "gone": gone + drop}}
            self._claim(Version(before.number + 1, tables, before.note))
        return gone + drop

    def restore(self, number: int, note: str = "") -> int:
        """A new version that is the same as an old one; nothing is copied."""
        old = self.version(number)
        if old is None:
            raise KeyError(number)
        latest = self.numbers()[-1]
        self._claim(Version(latest + 1, old.tables, note or f"restores {number}"))
        return latest + 1

    # ---- space

    def _named(self, keep: int) -> set[str]:
        return {f for n in self.numbers()[-keep:] for t in self.version(n).tables.values() for f in t["folders"]}

    def space(self, keep: int = 1) -> dict[str, int]:
        """Bytes of all data files, of those that the last ``keep`` versions name, and of the rest."""
        named = self._named(keep)
        every = self.files(f"{self.root}/data")
        of = lambda at: any(f"/{f}/" in at for f in named)
        live = sum(size for at, size in every.items() if of(at))
        return {"bytes": sum(every.values()), "live_bytes": live, "dead_bytes": sum(every.values()) - live}

    def vacuum(self, keep: int = 1) -> dict[str, int]:
        """Delete versions but the last ``keep``, and data that those don't name. No writer may be at work."""
        if keep < 1:
            raise ValueError("at least one version stays")
        named, fs, gone = self._named(keep), self._fs(), 0
        for number in self.numbers()[:-keep]:
            fs.delete(self._path(f"{self.root}/versions/{number:012d}.json"), False)
        for table in self._children(f"{self.root}/data"):
            for part in self._children(table.getPath().toString()):
                at = f"data/{table.getPath().getName()}/{part.getPath().getName()}"
                if at not in named:
                    gone += sum(self.files(part.getPath().toString()).values())
                    fs.delete(part.getPath(), True)
        return {"freed_bytes": gone, **self.space(keep)}


def scope_space(store: Store, name: str, scope: str, size: Column, forgotten: DataFrame) -> DataFrame:
    """``(scope_id, state, rows, payload_bytes, file_bytes)`` of a stored table: a scope's rows, the bytes of what they hold, and its share of the files.

    state: ``live`` or ``forgotten``. A file's bytes are shared out by the payload of its rows, so the shares add
    up to the files' sizes but for the last digits; files without payload belong to nobody.
    """
    frame = store.read(name)
    sizes = {at.rsplit("/", 1)[-1]: n for folder in store.version().tables[name]["folders"] for at, n in store.files(f"{store.root}/{folder}").items()}
    files = store.spark.createDataFrame(list(sizes.items()), "file string, bytes bigint")
    rows = frame.select(F.col(scope).alias("scope_id"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("payload"), F.col("_metadata.file_name").alias("file"))
    each = rows.groupBy("file", "scope_id").agg(F.count("*").alias("rows"), F.sum("payload").alias("payload"))
    whole = each.groupBy("file").agg(F.sum("payload").alias("whole"))
    shared = each.join(whole, "file").join(files, "file").withColumn("share", F.when(F.col("whole") > 0, F.col("bytes") * F.col("payload") / F.col("whole")).otherwise(0.0))
    out = shared.groupBy("scope_id").agg(F.sum("rows").alias("rows"), F.sum("payload").alias("payload_bytes"), F.sum("share").alias("file_bytes"))
    gone = forgotten.select("scope_id", F.lit(True).alias("gone")).distinct()
    return out.join(gone, "scope_id", "left").select("scope_id", F.when(F.col("gone"), "forgotten").otherwise("live").alias("state"), "rows", "payload_bytes", F.round("file_bytes").cast("bigint").alias("file_bytes"))


def vacuum_report(store: Store, name: str, scope: str, size: Column, forgotten: DataFrame) -> dict[str, int]:
    """Rewrite a table without its forgotten scopes and free the old files; what that took and gave."""
    before = store.files(f"{store.root}/data/{name}")
    held = scope_space(store, name, scope, size, forgotten).groupBy("state").agg(F.sum("rows").alias("rows"), F.sum("payload_bytes").alias("bytes"), F.count("*").alias("scopes")).collect()
    of = {r["state"]: r for r in held}
    live = store.read(name).join(forgotten.select(F.col("scope_id").alias(scope)).distinct(), scope, "left_anti")
    number = store.commit({name: live.select(*store.read(name).columns)}, note=f"vacuum of {name}")
    freed = store.vacuum(1)
    after = store.files(f"{store.root}/data/{name}")
    told = {f"{state}_{what}": int(of[state][what]) if state in of else 0 for state in ("live", "forgotten") for what in ("scopes", "rows", "bytes")}
    return {**told, "version": number, "file_bytes_before": sum(before.values()), "file_bytes_after": sum(after.values()), "freed_bytes": freed["freed_bytes"]}
