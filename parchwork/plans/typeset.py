"""Deterministic spans from plain texts: words laid out ten to a line, for tables that hold no PDF files."""

from __future__ import annotations

import re

import numpy as np

from parchwork.kernels.layout import Spans

WORDS_PER_LINE = 10
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def spans_of(text: str) -> Spans:
    """The spans of a text's one page."""
    words = _WORD.findall(text)
    n, at = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
    line, step = at // WORDS_PER_LINE, 5 * n + n % 3
    before = np.cumsum(step) - step
    x = (before - before[line * WORDS_PER_LINE]).astype(float)
    y = (14 * line + 7 * n % 9).astype(float)
    size = np.where(line % 40 == 0, 14.0, 10.0)
    return Spans(x, y, x + 5 * n, y + size, size, line % 40 == 1, words)
