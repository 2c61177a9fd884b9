"""Small helpers shared by the operators that run Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows handled at once inside a task; bounds the Python objects alive at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most `rows` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as no bytes."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]
