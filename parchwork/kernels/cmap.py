"""Character maps of composite fonts: code to Unicode text."""

from __future__ import annotations

import logging
from typing import NamedTuple

from parchwork.kernels.objects import Parser, PdfError, Word, _Mark

log = logging.getLogger(__name__)


class CodeRange(NamedTuple):
    low: int
    high: int


class Mapping(NamedTuple):
    src: int
    dst: str
    byte_length: int


class CMap(NamedTuple):
    code_space: list[CodeRange]
    mappings: list[Mapping]
    byte_length: int


def utf16(data: bytes) -> str:
    """UTF-16BE text; an odd last byte is a code of its own."""
    if len(data) % 2:
        data = data[:-1] + b"\0" + data[-1:]
    return data.decode("utf-16-be", "surrogatepass")


def _tuples(items: list, size: int, what: str) -> list[list]:
    if len(items) % size:
        raise PdfError(f"{what} without all of its parts")
    return [items[i : i + size] for i in range(0, len(items), size)]


def _successor(dst: bytes, by: int) -> bytes:
    return (int.from_bytes(dst, "big") + by).to_bytes(len(dst), "big")


def parse_cmap(data: bytes) -> CMap:
    """Code-space ranges and the bfchar and bfrange mappings; all else is skipped.

    Parts may stand on one line or several. The byte length is the first
    mapping's, 1 without any.
    """
    spaces: list[CodeRange] = []
    mappings: list[Mapping] = []
    parser, items, inside = Parser(data), [], None
    array: list | None = None
    while True:
        t = parser.token(references=False)
        if isinstance(t, _Mark):
            if t.kind == "end":
                break
            if t.kind == "[" and inside:
                array = []
            elif t.kind == "]" and array is not None:
                items.append(array)
                array = None
            continue
        if isinstance(t, Word) and t.startswith("begin") and t[5:] in ("codespacerange", "bfchar", "bfrange"):
            inside, items = t[5:], []
        elif isinstance(t, Word) and inside and t == "end" + inside:
            if inside == "codespacerange":
                spaces += [CodeRange(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in _tuples(items, 2, inside)]
            elif inside == "bfchar":
                mappings += [Mapping(int.from_bytes(a, "big"), utf16(b), len(a)) for a, b in _tuples(items, 2, inside)]
            else:
                for low, high, dst in _tuples(items, 3, inside):
                    if len(low) != len(high):
                        raise PdfError("bfrange with ends of different length")
                    first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    if isinstance(dst, list):
                        if len(dst) != last - first + 1:
                            raise PdfError("bfrange whose array has another length than its range")
                        mappings += [Mapping(first + i, utf16(d), len(low)) for i, d in enumerate(dst)]
                    else:
                        mappings += [Mapping(code, utf16(_successor(dst, code - first)), len(low)) for code in range(first, last + 1)]
            inside, items = None, []
        elif inside:
            (items if array is None else array).append(t)
    length = mappings[0].byte_length if mappings else 1
    if any(m.byte_length != length for m in mappings):
        log.warning("character map with codes of several lengths")
    return CMap(spaces, mappings, length)
