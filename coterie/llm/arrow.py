"""Row-wise Python steps over Arrow batches that append columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on; a longer single text is its own step.
STEP_BYTES = 1 << 18
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS, ROWS_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of rows that are handed on together, so that a worker holds little at a time.
SLICE_BYTES = 1 << 22


def map_batches(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows.  A row may hold a long text, and the
    default of 10,000 rows would be copied on both sides of the pipe as one piece; so
    the session's number is lowered, unless it is lower already."""
    conf = df.sparkSession.conf
    if int(conf.get(ROWS_SETTING)) > BATCH_ROWS:
        conf.set(ROWS_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def appended(df: DataFrame, added: str, function: Callable[[pa.RecordBatch], dict],
             without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``added`` (DDL), which ``function`` makes batch by
    batch, and without the columns ``without``.  Columns of ``df`` with the same names
    are replaced."""
    new = StructType.fromDDL(added)
    df = df.drop(*(name for name in new.names if name not in without))
    kept = [field for field in df.schema.fields if field.name not in without]
    return map_batches(df, _Appender(function, new, [field.name for field in kept]), StructType(kept + new.fields))


class _Appender:
    def __init__(self, function, new, kept):
        self.function, self.new, self.kept = function, new, kept

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(self.new)
        for batch in slices(batches):
            made = self.function(batch)
            arrays = [batch.column(batch.schema.get_field_index(name)) for name in self.kept]
            for field in fields:
                value = made[field.name]
                arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
            yield pa.RecordBatch.from_arrays(arrays, names=[*self.kept, *fields.names])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        size = max(1, int(len(batch) * min(1.0, SLICE_BYTES / max(1, batch.nbytes))))
        for lo in range(0, len(batch), size):
            yield batch.slice(lo, size)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offset of each text; a null
    text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
