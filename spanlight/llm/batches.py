"""Help for Arrow functions inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut batches into runs of rows with about ``limit`` bytes of ``column``, and the column as a list.

    A single longer text is a run of its own, so memory depends on the longest text only. Memory goes back to the
    system after the last batch, as a Python worker lives on between tasks.
    """
    for batch in batches:
        at, size = 0, 0
        column_at = batch.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column_at)), 0).to_pylist()
        for k, n in enumerate(lengths):
            if k > at and size + n > limit:
                part = batch.slice(at, k - at)
                yield part, part.column(column_at).to_pylist()
                at, size = k, 0
            size += n
        if at < len(lengths):
            part = batch.slice(at)
            yield part, part.column(column_at).to_pylist()
    release()


def release() -> None:
    """Give unused memory back: Arrow's, and what the C library holds on to (where it is glibc)."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def record_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    made = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, schema, strict=True)], schema=schema)
