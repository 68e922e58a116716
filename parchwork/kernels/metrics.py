"""Widths of the core fonts, for files that leave them out.

Listed are the characters of ASCII and a few others; a letter with a mark is as
wide as the letter. Symbol and ZapfDingbats are not listed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

_DIGITS = " 556 556 556 556 556 556 556 556 556 556 "
_TIMES_DIGITS = _DIGITS.replace("556", "500")
# Widths of U+0020 to U+007E in thousandths of the font size.
ASCII_WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278" + _DIGITS + "278 278 584 584 584 556 1015 "
    "667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 "
    "556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278" + _DIGITS + "333 333 584 584 584 611 975 "
    "722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 "
    "556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278" + _TIMES_DIGITS + "278 278 564 564 564 444 921 "
    "722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 "
    "444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278" + _TIMES_DIGITS + "333 333 570 570 570 500 930 "
    "722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 "
    "500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278" + _TIMES_DIGITS + "333 333 675 675 675 500 920 "
    "611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 "
    "500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278" + _TIMES_DIGITS + "333 333 570 570 570 500 832 "
    "667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 "
    "500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
# Widths of further characters, in the order of the fonts above.
OTHER_WIDTHS = {
    "‘’": (222, 278, 333, 333, 333, 333), "‚": (222, 278, 333, 333, 333, 333), "“”": (333, 500, 444, 500, 556, 500), "„": (333, 500, 444, 500, 556, 500),
    "–": (556, 556, 500, 500, 500, 500), "—": (1000, 1000, 1000, 1000, 889, 1000), "•": (350, 350, 350, 350, 350, 350), "…": (1000, 1000, 1000, 1000, 889, 1000),
    "ﬁﬂ": (500, 611, 556, 556, 500, 556), "ß": (611, 611, 500, 556, 500, 500), "ı": (278, 278, 278, 278, 278, 278), "†‡": (556, 556, 500, 500, 500, 500),
    "\xa0": (278, 278, 250, 250, 250, 250), "Æ": (1000, 1000, 889, 1000, 889, 944), "æ": (889, 889, 667, 722, 667, 722), "Œ": (1000, 1000, 889, 1000, 944, 944),
    "œ": (944, 944, 722, 722, 667, 722), "Ø": (778, 778, 722, 778, 722, 722), "ø": (611, 611, 500, 500, 500, 500), "©®": (737, 737, 760, 747, 760, 747),
    "«»": (556, 556, 500, 500, 500, 500), "¡": (333, 333, 333, 333, 389, 389), "¿": (611, 611, 444, 500, 500, 500), "°": (400, 400, 400, 400, 400, 400),
}
#: Slanted fonts that are as wide as an upright one.
SAME = {"Helvetica-Oblique": "Helvetica", "Helvetica-BoldOblique": "Helvetica-Bold"}


@cache
def core_widths(font: str) -> dict[str, float] | None:
    """Text to width of a core font; null for a font that is none, empty where widths are not listed."""
    if font.startswith("Courier") and font in ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"):
        return _with_marks({chr(c): 600.0 for c in range(0x20, 0x7F)} | {c: 600.0 for chars in OTHER_WIDTHS for c in chars})
    if font in ("Symbol", "ZapfDingbats"):
        return {}
    name = SAME.get(font, font)
    if name not in ASCII_WIDTHS:
        return None
    found = {chr(0x20 + i): float(w) for i, w in enumerate(ASCII_WIDTHS[name].split())}
    place = list(ASCII_WIDTHS).index(name)
    return _with_marks(found | {c: float(widths[place]) for chars, widths in OTHER_WIDTHS.items() for c in chars})


def _with_marks(found: dict[str, float]) -> dict[str, float]:
    marked = {}
    for code in [*range(0xC0, 0x180), *range(0x218, 0x21C)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in found:
            marked[chr(code)] = found[parts[0]]
    return marked | found
