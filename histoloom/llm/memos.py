"""What operators remember in a worker process between tasks.

Spark reuses Python workers, so one process may serve tasks of several operators
in turn. Each lets go of what the others remember before it begins.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    """Registers a memo; ``forget`` empties it."""
    _held[name] = forget


def only(name: str | None = None) -> None:
    """Empties all memos but one, and gives freed memory back."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass
