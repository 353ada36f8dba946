"""What tasks of one Python worker share, and the columns of Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

_STORE = "_textquarry_worker_store"
_KEPT = 4


def shared(key: Any, make: Callable[[], Any], version: Any = None) -> Any:
    """A value made once per Python worker and kept between its tasks.

    Functions travel by value, so a module's globals are new in every task; a module object
    in ``sys.modules`` stays for the life of the worker. A new version takes the place of the
    one before, and only the values used last are kept, so what one operator held goes when a
    worker turns to another.
    """
    module = sys.modules.setdefault(_STORE, types.ModuleType(_STORE))
    store = module.__dict__.setdefault("values", {})
    held = store.pop(key, None)
    if held is None or held[0] != version:
        held = None
        while len(store) >= _KEPT:
            store.pop(next(iter(store)))
        held = version, make()
    store[key] = held
    return held[1]


def release() -> None:
    """Drop all that ``shared`` keeps in this worker and hand free memory back to the system, so
    that an idle worker holds little beside what other stages of a job run."""
    module = sys.modules.get(_STORE)
    if module is not None:
        module.__dict__.get("values", {}).clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, with a release behind its last batch."""

    def once(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return once


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(ends, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def row_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``size`` bytes of text each, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield batch.slice(a, b - a)
        a = b
