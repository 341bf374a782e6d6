"""The catalogue of queries: an operator applied to a dataset, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.sources import views as _views

Build = Callable[["Views"], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}
#: The moment at which everything that depends on the clock is judged: 2024-02-01 00:00:00 UTC.
AS_OF = 1_706_745_600


class Views:
    """A dataset's tables and the views built on them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        found = _views.spark_view(self.spark, self.sf_dir, name)
        setattr(self, name, found)
        return found


def query(op: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under the operator's id, with dots as underscores.

    sql may name any table or view of ``sources.views``; the views it needs are put before it.
    """

    def add(build: Build) -> Build:
        name = op.replace(".", "_")
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return add


def with_views(sql: str) -> str:
    """The SQL with the definitions of the views that it names, in order of their needs."""
    parts = _views.definitions(sql)
    if not parts:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    recursive = "RECURSIVE " if own and own[1] else ""
    head = ", ".join(f"{name} AS ({text})" for name, text in parts)
    return f"WITH {recursive}{head}, {sql[own.end():]}" if own else f"WITH {head} {sql}"


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The registered query as a function of session and dataset folder."""

    @functools.wraps(QUERIES[name])
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return QUERIES[name](Views(spark, sf_dir))

    return call
