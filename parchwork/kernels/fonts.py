"""Fonts: what their codes mean and how wide they are."""

from __future__ import annotations

import codecs
import logging
import re
from functools import cached_property, lru_cache
from typing import Any

import numpy as np

from parchwork.kernels.cmap import parse_cmap
from parchwork.kernels.document import Document
from parchwork.kernels.encodings import expand_differences, glyph_text, glyphmap
from parchwork.kernels.filters import as_list
from parchwork.kernels.metrics import core_widths
from parchwork.kernels.objects import Name, PdfError, Stream

log = logging.getLogger(__name__)

@lru_cache
def _base_texts(encoding: str) -> dict[int, str]:
    """Code to text of an encoding's known glyphs."""
    return {code: text for code, name in glyphmap(encoding).items() if (text := glyph_text(name)) is not None}


def overlay(*layers: dict[int, str] | None) -> dict[int, str]:
    """Codes from all layers; the last one that defines a code wins."""
    found: dict[int, str] = {}
    for layer in layers:
        found |= layer or {}
    return found


def type1_program(clear: bytes) -> tuple[str | None, dict[int, str], str | None]:
    """Base encoding, ``dup code /name put`` entries and weight from a Type 1 program's clear text."""
    text = clear.decode("latin-1")
    base = re.search(r"/Encoding\s+(StandardEncoding)\s+def", text)
    dups = {int(code): name for code, name in re.findall(r"dup\s+(\d+)\s*/(\S+)\s+put", text)}
    weight = re.search(r"/Weight\s*\(([^)]*)\)", text)
    return base[1] if base else None, dups, weight[1] if weight else None


def cid_widths(items: list, resolve: Any = lambda x: x) -> dict[int, float]:
    """Code to width from a W array, a mix of ``c [w ...]`` and ``first last w``; the later wins."""
    found: dict[int, float] = {}
    items = [resolve(x) for x in items]
    i = 0
    while i + 1 < len(items):
        if isinstance(items[i + 1], list):
            found |= {items[i] + k: float(resolve(w)) for k, w in enumerate(items[i + 1])}
            i += 2
        elif i + 2 < len(items):
            found |= dict.fromkeys(range(items[i], items[i + 1] + 1), float(items[i + 2]))
            i += 3
        else:
            break
    return found


class Font:
    """A view of a font dictionary. ``metrics`` gives widths by text for fonts that a file leaves them out of, before those of the core fonts; ``glyphs`` gives texts of further glyph names."""

    def __init__(self, document: Document, dictionary: dict, metrics: dict[str, dict[str, float]] | None = None, glyphs: dict[str, str] | None = None):
        self.document, self.dictionary, self.metrics, self.glyphs = document, dictionary, metrics or {}, glyphs
        self.composite = dictionary.get("Subtype") == "Type0"

    def _get(self, key: str, of: Any = None) -> Any:
        return self.document.get(self.dictionary if of is None else of, key)

    @cached_property
    def descendant(self) -> dict:
        return self.document.resolve(self._get("DescendantFonts")[0]) if self.composite else self.dictionary

    @cached_property
    def descriptor(self) -> dict:
        return self._get("FontDescriptor", self.descendant) or {}

    @cached_property
    def base_font(self) -> str:
        return str(self._get("BaseFont") or "")

    @cached_property
    def _program(self) -> tuple[str | None, dict[int, str], str | None]:
        stream = self._get("FontFile", self.descriptor)
        if not isinstance(stream, Stream):
            return None, {}, None
        length = self.document.get(stream, "Length1")
        return type1_program(self.document.decoded(stream)[:length])

    def _names(self) -> list[str]:
        return [self.base_font, str(self.descriptor.get("FontName") or "")]

    @cached_property
    def bold(self) -> bool:
        weight = self._get("FontWeight", self.descriptor)
        return any("bold" in n.lower() for n in self._names()) or (isinstance(weight, (int, float)) and weight >= 700) or "bold" in (self._program[2] or "").lower()

    @cached_property
    def italic(self) -> bool:
        return any("italic" in n.lower() for n in self._names()) or bool(self._get("ItalicAngle", self.descriptor))

    @cached_property
    def _cmap(self):
        stream = self._get("ToUnicode")
        return parse_cmap(self.document.decoded(stream)) if isinstance(stream, Stream) else None

    @cached_property
    def char_bytes(self) -> int:
        """Bytes of a code."""
        if self._cmap and self._cmap.mappings:
            return self._cmap.byte_length
        return 2 if self.composite else 1

    @cached_property
    def encoding(self) -> dict[int, str]:
        """Code to text, by layers: base encoding, what the descriptor or font program says, ToUnicode, standard encoding if all that is empty, Differences."""
        given = self._get("Encoding")
        base = str(given) if isinstance(given, Name) else str(self._get("BaseEncoding", given) or "") if isinstance(given, dict) else ""
        if base and not glyphmap(base) and not base.startswith("Identity"):
            log.info("unknown base encoding %s", base)
        charset = self.descriptor.get("CharSet")
        glyphs = [g for g in charset.decode("latin-1").split("/") if g] if isinstance(charset, bytes) else []
        first = self._get("FirstChar")
        if len(glyphs) == 1 and isinstance(first, int):
            described: dict[int, str] = {first: glyphs[0]}
        else:
            described = glyphmap(self._program[0] or "") | self._program[1]
        named = lambda names: {code: text for code, name in names.items() if (text := glyph_text(name, self.glyphs)) is not None}
        found = overlay(named(glyphmap(base)) if self.glyphs else _base_texts(base), named(described), {m.src: m.dst for m in self._cmap.mappings} if self._cmap else None)
        if not found and not self.composite:
            found = named(glyphmap("StandardEncoding"))
        differences = self._get("Differences", given) if isinstance(given, dict) else None
        return overlay(found, named(expand_differences([self.document.resolve(x) for x in differences or []])))

    def codes(self, data: bytes) -> list[int]:
        """Big-endian codes of ``char_bytes`` bytes; an incomplete last one counts as it is."""
        n = self.char_bytes
        return list(data) if n == 1 else [int.from_bytes(data[i : i + n], "big") for i in range(0, len(data), n)]

    def decode(self, data: bytes, skip_missing: bool = True) -> str:
        """The text of a string; a code without text is left out or shown as ``\\u{hex}``."""
        table = self.encoding
        if skip_missing and self._characters is not None:
            return codecs.charmap_decode(data, "ignore", self._characters)[0]
        return "".join(table.get(c, "" if skip_missing else f"\\u{{{c:x}}}") for c in self.codes(data))

    @cached_property
    def _characters(self) -> str | None:
        """The texts of codes of a single byte, where each has one character; U+FFFE for none."""
        if self.char_bytes != 1:
            return None
        texts = list(map(self.encoding.get, range(256), ["\ufffe"] * 256))
        joined = "".join(texts)
        return joined if len(joined) == 256 and "" not in texts and "\ufffe" not in self.encoding.values() else None

    @cached_property
    def _whole_widths(self) -> np.ndarray | None:
        """The widths of codes of a single byte, where all are whole numbers: their sum does not depend on its order."""
        table, default = self.widths
        listed = np.array(list(map(table.get, range(256), [default] * 256)), float)
        return listed if self.char_bytes == 1 and (np.rint(listed) == listed).all() and (np.abs(listed) < 2**20).all() else None

    @cached_property
    def widths(self) -> tuple[dict[int, float], float]:
        """Code to width in thousandths of the font size, and the width of any other code."""
        if self.composite:
            default = self._get("DW", self.descendant)
            return cid_widths(as_list(self._get("W", self.descendant)), self.document.resolve), 1000.0 if default is None else float(default)
        listed, first = self._get("Widths"), self._get("FirstChar") or 0
        missing = self.descriptor.get("MissingWidth")
        if listed is not None:
            matrix = self._get("FontMatrix")
            scale = float(self.document.resolve(matrix[0])) / 0.001 if matrix else 1.0
            resolve = self.document.resolve
            return {first + i: float(w if type(w) is int else resolve(w)) * scale for i, w in enumerate(listed)}, float(missing or 0)
        if missing is not None:
            return {}, float(missing)
        name = self.base_font.partition(",")[0]
        known = self.metrics.get(name, core_widths(name))
        if known is None:
            raise PdfError(f"font {self.base_font or '?'} has no widths")
        return {c: known[t] for c, t in self.encoding.items() if t in known}, 1000.0

    def measure(self, data: bytes) -> float:
        """Sum of the widths of a string's codes."""
        if self._whole_widths is not None:
            return float(self._whole_widths[np.frombuffer(data, np.uint8)].sum())
        table, default = self.widths
        return sum(table.get(c, default) for c in self.codes(data))
