"""Arrow batches cut to a bounded number of bytes, so that long rows don't gather in memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20


@lru_cache(maxsize=1)
def _c_library():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return None


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _c_library():
        _c_library()(0)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that the column's values of each have about `most` bytes, or one row."""
    gc.set_threshold(200_000, 20, 100)  # workers keep large tables without cycles
    give_back()
    for batch in batches:
        if batch.num_rows and batch.nbytes > most:
            values = batch.column(column)
            if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
                sizes = np.diff(np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64))
            else:
                lists = pa.types.is_list(values.type)
                sizes = np.diff(values.offsets.to_numpy()).astype(np.int64) * 4 if lists else np.full(len(values), batch.nbytes // batch.num_rows)
            group = (np.cumsum(sizes) - sizes) // most
            starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(values)]
            for a, b in zip(starts, starts[1:]):
                yield batch.slice(a, b - a)
        else:
            yield batch
    give_back()
