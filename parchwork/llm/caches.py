"""Tables that a Python worker keeps between tasks, for one operator at a time.

Workers outlive stages. What one operator keeps (a compiled model, word
encodings, random vectors) would otherwise stay while another needs the memory.
"""

from __future__ import annotations

from collections.abc import Callable

_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, clear: Callable[[], None]) -> None:
    """Register how to let go of an operator's tables."""
    _kept[owner] = clear


def begin(owner: str) -> None:
    """An operator's task begins in this worker: the others' tables go."""
    for other, clear in _kept.items():
        if other != owner:
            clear()
