"""What a Python worker keeps from task to task.

Spark hands its Python workers on from job to job, so what one operator has kept there
would lie beside what the next one needs.  A worker keeps things for one operator at a
time: the first task of another operator drops them and gives their memory back.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_kept: dict = {}
_owner: list[str | None] = [None]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Give memory that is free, but still held by this process, back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def kept(owner: str) -> dict:
    """The things that this worker keeps for ``owner``, empty after another's tasks."""
    if _owner[0] != owner:
        _kept.clear()
        gc.collect()
        released()
        _owner[0] = owner
    return _kept
