"""Memory of the Python workers between tasks.

A worker serves many tasks of many stages. What a task freed stays with the allocators of Arrow and of the C library, so a worker's size would be
that of the largest task it ever ran. Tasks wrapped here hand it back when they end.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task over batches, which hands back its memory at its end."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()
    return run
