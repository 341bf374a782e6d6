"""Running a function over batches of texts, with other columns carried along in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_texts(frame: DataFrame, texts: str, carry: list[str], schema: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The columns ``carry`` of ``frame`` and those of ``schema``.

    ``make`` is called once per task; what it returns gets a batch's texts (null: None) and
    returns a column (a list or array) for each field of ``schema``. Carried columns keep
    their types and nulls: they never become pandas values. No batch exceeds Spark's own
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    extra = StructType.fromDDL(schema)
    names = list(dict.fromkeys([*carry, texts]))
    out = StructType([frame.schema[c] for c in carry] + extra.fields)
    types = [f.type for f in to_arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            got = of(b.column(names.index(texts)).to_pylist())
            cols = [b.column(names.index(c)) for c in carry] + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return frame.select(*names).mapInArrow(run, out)
