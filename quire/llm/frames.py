"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa


def replace_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with a column of that name at its end, in place of one there before."""
    keep = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def texts(column: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that aren't UTF-8 count as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode(errors="replace") for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values of a column take up to about `limit` bytes."""
    if not batch.num_rows:
        return
    step = max(1, min(batch.num_rows, limit * batch.num_rows // max(1, batch.column(column).nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, min(step, batch.num_rows - start))


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Gives back memory that the worker holds free, as workers are used again."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end, memory that isn't used any more is given back."""
    # The other pools keep large blocks for later.
    pa.set_memory_pool(pa.system_memory_pool())
    yield from batches
    give_back()
