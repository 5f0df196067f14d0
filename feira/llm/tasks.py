"""What a Python task leaves behind in its worker.

Workers are reused by later tasks and stages, and those that wait stay too. What their allocators keep of arrays that are
long gone counts against the executor all that time, beside the heap of its JVM.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None  # the C library has no such call


def give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """``run``, and free memory goes back to the system when the task ends, also when it fails."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
