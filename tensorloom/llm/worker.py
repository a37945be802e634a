"""What a Python worker keeps: workers serve several operators one after another, and their memory counts all the time."""

from __future__ import annotations

import ctypes

_slot: dict = {}


def held(key, make):
    """What make() gave for the key: one large thing a worker; whatever was held for another key goes first."""
    if key not in _slot:
        free()
        _slot[key] = make()
    return _slot[key]


def free() -> None:
    _slot.clear()
    trim()


def trim() -> None:
    """Gives memory that is free back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
