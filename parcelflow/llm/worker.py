"""What a Python worker keeps for all tasks it serves, and what it gives back."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa

_STORE = "_parcelflow_worker_store"


def once(key: tuple, make: Callable):
    """``make()`` of the first call with this key in this process.

    Functions reach workers by value, with globals of their own for each task, so the store is a module.
    """
    kept = sys.modules.setdefault(_STORE, ModuleType(_STORE)).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; memory it freed goes back to the system at the task's end.

    A worker outlives its tasks, and what its allocators hold back counts against the executor in every later stage.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied
