"""Words of a text: runs of anything but the six ASCII white-space characters.

Python's ``bytes.split`` without arguments cuts at just these six, and ``bytes.lower`` changes A-Z alone, so UTF-8
bytes give the words without a regular expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows, and bytes of text, that a Python worker turns into objects at a time; a longer text is taken alone.
ROWS = 512
BYTES = 8 << 20


#: Words that a memo of a task holds before it is emptied.
MEMO = 150_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches.  What Arrow holds free after the last is given back, as a worker goes on to other tasks."""
    for batch in batches:
        bulk = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                bulk += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.append(0, bulk.cumsum()), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(upto, upto[at] + size, "right")) - 1
            stop = min(max(at + 1, full), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of a string column as UTF-8; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``run``, which keeps the columns.  Names with dots or quotes, which ``mapInArrow`` would take apart,
    are others meanwhile."""
    plain = docs.toDF(*[f"_column{k}" if set(c) & set(".`") else c for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
