"""Row-wise Python over Arrow batches with bounded working sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of input that are held as Python objects at once.
SLICE_BYTES = 16 << 20


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema; needs a session."""
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes; one row is never split."""
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes)))) if rows else 1
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def map_columns(
    df: DataFrame, columns: Sequence, schema: str, make: Callable[[], Callable[..., Sequence]]
) -> DataFrame:
    """Applies make()(list, list, ...) -> lists to slices of the chosen columns.

    ``make`` is called once a task, so that models and caches live as long as the task.
    Only the chosen columns are read; the output has the columns of ``schema`` alone, so
    further columns of the input, whatever their names, can't clash with it."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch):
                results = apply(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [r if isinstance(r, pa.Array) else pa.array(r, f.type) for r, f in zip(results, out, strict=True)],
                    schema=out,
                )

    return df.select(*columns).mapInArrow(run, schema)
