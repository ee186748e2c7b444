"""Memory of Python workers, which stay for later tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from ..workers import BATCH_ROWS, SETTING, small_batches

__all__ = ["BATCH_ROWS", "SETTING", "drop_caches", "give_back", "small_batches", "tidy", "worker_cache"]

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Freed memory goes back to the system; an idle worker otherwise keeps the peak of its last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: What operators keep in a worker for its later tasks, by name.
_caches: dict[str, dict] = {}


def worker_cache(name: str, cache: dict) -> dict:
    _caches[name] = cache
    return cache


def drop_caches(keep: str = "") -> None:
    """Empty the caches of other operators: a worker goes from one stage to the next, and would hold those of all."""
    for name, cache in _caches.items():
        if name != keep:
            cache.clear()


def tidy(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """A function over batches that drops what other operators keep in the worker, and gives back its own memory when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        drop_caches(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
