"""What a Python worker keeps from task to task.

Encoders and word tables are worth keeping between the tasks of one operator, and in the way of the
next one: a worker keeps those of one operator at a time and hands the memory back before it turns
to another's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The value kept under ``key``, made if it isn't there; what other keys hold is let go."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
        _kept[key] = make()
    return _kept[key]
