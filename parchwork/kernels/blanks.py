"""White space and spacing modifiers of texts."""

from __future__ import annotations

import re
import unicodedata

#: White space as the layout rules mean it, as the inside of a character class.
BLANK = r"\t\n\x0B\f\r    -     　﻿"
# Spacing modifiers and the combining marks they stand for.
COMBINING = {
    "^": "̂", "`": "̀", "¨": "̈", "¯": "̄", "´": "́", "¸": "̧", "ˆ": "̂",
    "ˇ": "̌", "ˉ": "̄", "ˊ": "́", "ˋ": "̀", "˘": "̆", "˙": "̇", "˚": "̊",
    "˛": "̨", "˜": "̃", "˝": "̋",
}
_MODIFIER = re.compile("([\\^`¨¯´¸ʰ-˿])(.)", re.DOTALL)
_RUN = re.compile(f"[{BLANK}]+")
_CONTROL = re.compile(r"[\x00-\x1F]+")
_SEEN = re.compile(f"[^{BLANK}]")


def is_blank(text: str) -> bool:
    """Whether a text holds white space only."""
    return _SEEN.search(text) is None


def normalize_blanks(text: str) -> str:
    """Runs of white space become one space, control characters vanish."""
    return _CONTROL.sub("", _RUN.sub(" ", text))


def compose(text: str) -> str:
    """A spacing modifier before a character becomes a combining mark after it (alone, where that is a space); then NFKC."""

    def one(m: re.Match) -> str:
        mark = COMBINING.get(m[1])
        return m[0] if mark is None else mark if m[2] == " " else m[2] + mark

    return unicodedata.normalize("NFKC", _MODIFIER.sub(one, text))


def normalize(text: str) -> str:
    """Blanks, control characters, modifiers, then compatibility composition."""
    text = normalize_blanks(text)
    return text if text.isascii() and "^" not in text and "`" not in text else compose(text)
