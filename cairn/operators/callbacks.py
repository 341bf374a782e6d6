"""A caller's model inside a job: batches of rows go in, an answer for each row comes out.

A call may fail as a whole. It is tried again, then cut in halves, so that one bad row takes no
other with it; a row that fails alone gets the fallback, and says so. No row is lost, and none
is answered twice. The model is built once per task, on the executor.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

Model = Callable[[list[dict]], list]


class Refused(Exception):
    """A model's way to say that trying again is of no use."""


def ask(model: Model, rows: list[dict], fallback: Callable[[dict], object], attempts: int, wait: float = 0.0) -> list[tuple[object, str]]:
    """An answer for each row, and where it is from: ``model``, ``retry`` or ``fallback``."""
    if not rows:
        return []
    for turn in range(attempts):
        try:
            answers = model(rows)
            if len(answers) != len(rows):
                raise ValueError("a model gives one answer for each row")
            return [(a, "retry" if turn else "model") for a in answers]
        except Refused:
            break
        except Exception:  # whatever a model raises, the other rows go on
            if wait and turn + 1 < attempts:
                time.sleep(wait * 2**turn)
    if len(rows) == 1:
        return [(fallback(rows[0]), "fallback")]
    half = len(rows) // 2
    return [(a, "retry" if s == "model" else s) for part in (rows[:half], rows[half:]) for a, s in ask(model, part, fallback, attempts, wait)]


def answered(frame: DataFrame, inputs: list[str], factory: Callable[[], Model], answer: str, fallback: Callable[[dict], object], attempts: int = 3, batch: int = 64, wait: float = 0.0) -> DataFrame:
    """``frame`` with ``answer`` (of the type given: "name type") and ``answered_by``. Only ``inputs`` are given to the model; the other columns stay in Arrow."""
    new = StructType.fromDDL(answer)
    if len(new.fields) != 1:
        raise ValueError("one answer a row; make it a struct")
    clash = {new.fields[0].name, "answered_by"} & set(frame.columns)
    if clash:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
    out = StructType(frame.schema.fields + new.fields + [StructField("answered_by", StringType())])
    kind = to_arrow_schema(new).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = ask(model, part.select(inputs).to_pylist(), fallback, attempts, wait)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in got], kind), pa.array([s for _, s in got], pa.string())], names=out.names)

    return frame.mapInArrow(run, out)
