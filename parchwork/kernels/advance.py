"""Where the glyphs of a straight run begin."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np

_DIGITS = Context(prec=80)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def advances(widths: np.ndarray, spaces: np.ndarray, size: float, char_space: float = 0.0, word_space: float = 0.0, scale: float = 100.0) -> np.ndarray:
    """The sum of the advances before each glyph: ((w / 1000) size + char_space + word_space on spaces) scale / 100. Added up in order."""
    step = (widths / 1000 * size + char_space + np.where(spaces, word_space, 0.0)) * scale / 100
    x = np.zeros(len(step))
    np.cumsum(step[:-1], out=x[1:])
    return x


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To so many decimal digits, halves away from zero, as a decimal number is rounded: what lies close to a half is looked at as one."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    large = ~(np.abs(x) < 2.0**52)  # no fraction to round
    found = np.where(large, x, whole / 10.0**digits)
    for i in np.flatnonzero(~large & ((np.abs(np.abs(scaled - whole) - 0.5) < 1e-3 + np.abs(scaled) * 1e-15) | (np.abs(scaled) >= 2.0**49))):
        found[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _DIGITS))
    return found
