"""Give memory that a Python worker has freed back to the system.

Workers outlive their tasks and are reused, and both Arrow's pool and the C allocator keep what was freed to them: an executor with several
workers, some of them idle, would hold each one's largest batch for good.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc: there is nothing to trim


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, a function for ``mapInArrow``, giving freed memory back after each batch that it has read and at its end."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            yield batch
            del batch
            _give_back()

    def wrapped(batches: Batches) -> Batches:
        yield from run(read(batches))
        _give_back()

    return wrapped
