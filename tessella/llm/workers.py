"""What a Python worker keeps between tasks: one large object at a time.

Workers are used again by later stages; an object that only an earlier stage needs would
count against the executor's memory all the while.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_held: list[tuple[Hashable, Any]] = []


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, made if the worker holds another one, which is let go first."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]


def none() -> None:
    """Lets go of whatever is held."""
    _held.clear()


def trim() -> None:
    """Gives memory that is no longer used back to the system; called when a task with large arrays ends."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
