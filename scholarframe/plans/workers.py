"""What Python workers keep between batches and tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it otherwise, also while the worker idles beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def handing_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what the work on one has freed goes back before the next, and at the end."""
    for batch in batches:
        yield batch
        del batch
        give_back()
    give_back()
