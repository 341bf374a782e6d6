"""Intermediate tables that outlive the executors which wrote them.

A materialised step is a Parquet table below the shared folder named by
``spark.checkpoint.dir``. Unlike ``localCheckpoint`` its blocks do not live on an
executor, and unlike a cached frame a lost executor never forces a recompute.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only where none is set and Spark is local."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set(_SETTING, root)
    return root


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting while what is inside is written; then what it was before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Names the durable tables of one job, and drops those it no longer needs.

    What a job returns still reads its last tables, so these stay until the session's
    program ends, or ``discard`` is called.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{job}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.discard)

    def keep(self, frame: DataFrame, name: str = "step", **options: str) -> DataFrame:
        """Write ``frame`` and read it back: the lineage ends here. options: those of the writer."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        frame.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, frame: DataFrame) -> None:
        """Delete the files behind a frame that ``keep`` returned."""
        own = self.root.rsplit("/", 1)[-1]
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if f"/{own}/" in path:
                self._delete(path)

    def discard(self) -> None:
        """Delete all tables of the job; nothing happens once Spark has stopped."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
