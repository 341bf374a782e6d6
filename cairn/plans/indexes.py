"""Stores of this program, and full-text indexes of tables, each written once and opened for all queries of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import postings as ix
from cairn.plans.durable import Scratch
from cairn.sources.versions import Store

_OPEN: dict[tuple, ix.Index] = {}


def new_store(spark: SparkSession, job: str) -> Store:
    """A store in the shared folder; it goes with the program's other tables."""
    return Store(spark, Scratch(spark, job).root)


def index_of(frame: DataFrame, doc: str, text: str) -> ix.Index:
    """An index of a table's files, which is written once and stays for the session; other files are another index."""
    key = (frame.sparkSession.sparkContext.applicationId, doc, text, *frame.columns, *sorted(frame.inputFiles()))
    if key not in _OPEN:
        store = new_store(frame.sparkSession, "index")
        ix.write(store, frame, doc, text)
        _OPEN[key] = ix.Index(store)
    return _OPEN[key]
