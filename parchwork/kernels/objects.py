"""Lexing and parsing of PDF objects from bytes.

Values: None, bool, int, float, :class:`Name`, bytes (both kinds of string),
list, dict, :class:`Ref`, :class:`Stream`, :class:`Indirect`. The parser is a
loop with an explicit stack, so nesting depth costs no recursion.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from typing import Any, NamedTuple


class PdfError(ValueError):
    """Malformed input, with the offset where it was noticed and what stands around it."""

    #: Bytes shown before and after the offset.
    CONTEXT = 256

    def __init__(self, message: str, offset: int | None = None, data: bytes | None = None):
        self.offset = offset
        snippet = b"" if data is None or offset is None else data[max(0, offset - self.CONTEXT) : offset + self.CONTEXT]
        super().__init__(message if offset is None else f"{message} at offset {offset}: {snippet!r}")


class Name(str):
    """A name object; distinct from strings, which are bytes."""

    __slots__ = ()


class Ref(NamedTuple):
    """A reference to an indirect object."""

    number: int
    generation: int = 0

    def __str__(self) -> str:
        return f"{self.number}:{self.generation}"

    @classmethod
    def parse(cls, text: str) -> Ref:
        """``number`` or ``number:generation``."""
        number, _, generation = text.partition(":")
        return cls(int(number), int(generation or 0))


class Stream(NamedTuple):
    dictionary: dict
    data: bytes


class Indirect(NamedTuple):
    ref: Ref
    value: Any


class _Mark(NamedTuple):
    kind: str
    offset: int


class Word(str):
    """A bare keyword, such as a content-stream operator."""

    __slots__ = ()


SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)")
NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+(R(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|obj)")
_INTEGERS = re.compile(rb"\[[\t\n\x0c\r 0-9]*\]")
#: In content streams, what most tokens are: a number, or a word that begins with a letter.
_PLAIN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:([+-]?(?:\d+\.?\d*|\.\d+))(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|([A-Za-z][^\x00\t\n\x0c\r ()<>\[\]{}/%]*))")
_HEX = re.compile(rb"<([0-9A-Fa-f\x00\t\n\x0c\r ]*)>")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r\n|\r|\n|.)?", re.DOTALL)
# Single-character escapes of literal strings.
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")


def unescape_name(raw: bytes) -> str:
    """A name's text: ``#hh`` stands for a byte. Bytes that are not UTF-8 are read as Latin-1."""
    data = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def hex_string(digits: bytes) -> bytes:
    """The bytes of a hexadecimal string; blanks are skipped and an odd last digit stands for its high half."""
    digits = _BLANK.sub(b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def _unescape(m: re.Match) -> bytes:
    what = m[1]
    if what is None or what in (b"\r", b"\n", b"\r\n"):
        return b""
    if what in _ESCAPED:
        return _ESCAPED[what]
    if what[0:1].isdigit() and what[0:1] < b"8":
        return bytes([int(what, 8) & 255])
    return what


_PAREN = re.compile(rb"\\.|[()]", re.DOTALL)


def literal_string(data: bytes, pos: int) -> tuple[bytes, int]:
    """The literal string whose opening parenthesis ends before ``pos``, and where it ends."""
    depth = 1
    for m in _PAREN.finditer(data, pos):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return _ESCAPE.sub(_unescape, data[pos : m.start()]), m.end()
    raise PdfError("string without an end", pos, data)


class Parser:
    """Reads values from bytes. ``resolve`` finds the value of a reference, for a stream's Length."""

    def __init__(self, data: bytes, pos: int = 0, resolve: Callable[[Ref], Any] | None = None):
        self.data, self.pos, self.resolve = data, pos, resolve

    def skip(self) -> None:
        self.pos = SKIP.match(self.data, self.pos).end()

    def token(self, references: bool = True) -> Any:
        """The next scalar, bracket mark or keyword; a mark of kind ``end`` at the end of the data."""
        self.skip()
        data, pos = self.data, self.pos
        lead = data[pos : pos + 1]
        if not lead:
            return _Mark("end", pos)
        if lead in b"0123456789+-.":
            if references and lead.isdigit() and (m := REFERENCE.match(data, pos)):
                self.pos = m.end()
                ref = Ref(int(m[1]), int(m[2]))
                return ref if m[3] == b"R" else Indirect(ref, None)
            if m := NUMBER.match(data, pos):
                self.pos = m.end()
                return float(m[0]) if b"." in m[0] else int(m[0])
        if lead == b"/":
            m = NAME.match(data, pos)
            self.pos = m.end()
            return Name(unescape_name(m[1]))
        if lead == b"(":
            value, self.pos = literal_string(data, pos + 1)
            return value
        if data.startswith((b"<<", b">>"), pos):
            self.pos = pos + 2
            return _Mark(data[pos : pos + 2].decode(), pos)
        if lead == b"<":
            if not (m := _HEX.match(data, pos)):
                raise PdfError("malformed hexadecimal string", pos, data)
            self.pos = m.end()
            return hex_string(m[1])
        if lead in b"[]{}":
            self.pos = pos + 1
            return _Mark(lead.decode(), pos)
        if m := WORD.match(data, pos):
            self.pos = m.end()
            return Word(m[0].decode("latin-1"))
        raise PdfError("unexpected byte", pos, data)

    def value(self) -> Any:
        """One complete value; the end of the data gives a mark of kind ``end``."""
        stack: list[tuple[str, list]] = []
        while True:
            t = self.token()
            if isinstance(t, _Mark):
                if t.kind == "[" and (m := _INTEGERS.match(self.data, t.offset)):  # as of widths
                    self.pos = m.end()
                    whole = [int(x) for x in m[0][1:-1].split()]
                    if not stack:
                        return whole
                    stack[-1][1].append(whole)
                    continue
                if t.kind in ("<<", "["):
                    stack.append((t.kind, []))
                    continue
                if t.kind == "end" and not stack:
                    return t
                if not stack or t.kind not in (">>", "]") or (t.kind == ">>") != (stack[-1][0] == "<<"):
                    raise PdfError(f"unexpected {t.kind}", t.offset, self.data)
                _, items = stack.pop()
                t = items if t.kind == "]" else self._dictionary(items)
            elif isinstance(t, Indirect):
                t = self._indirect(t.ref)
            elif isinstance(t, Word):
                if t not in ("true", "false", "null"):
                    raise PdfError(f"unexpected keyword {t}", self.pos - len(t), self.data)
                t = {"true": True, "false": False, "null": None}[t]
            if not stack:
                return t
            stack[-1][1].append(t)

    def _dictionary(self, items: list) -> dict | Stream:
        if len(items) % 2 or not all(isinstance(k, Name) for k in items[::2]):
            raise PdfError("dictionary with a key that is no name", self.pos, self.data)
        found = {str(k): v for k, v in zip(items[::2], items[1::2], strict=True)}
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)").match(self.data, self.pos)
        if not m:
            return found
        length = found.get("Length")
        if isinstance(length, Ref):
            if self.resolve is None:
                raise PdfError("a stream's length is a reference, and there is no document to look it up", self.pos, self.data)
            length = self.resolve(length)
        start = m.end()
        tail = re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, start + length) if isinstance(length, int) and length >= 0 else None
        if tail is None:  # a wrong length: the keyword decides
            at = self.data.find(b"endstream", start)
            if at < 0:
                raise PdfError("stream without an end", start, self.data)
            self.pos = at + len(b"endstream")
            return Stream(found, re.sub(rb"(\r\n|\n|\r)\Z", b"", self.data[start:at]))
        self.pos = tail.end()
        return Stream(found, self.data[start : start + length])

    def _indirect(self, ref: Ref) -> Indirect:
        value = self.value()
        end = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*endobj").match(self.data, self.pos)
        if end:
            self.pos = end.end()
        return Indirect(ref, value)


def parse_value(data: bytes, pos: int = 0, resolve: Callable[[Ref], Any] | None = None) -> Any:
    """The value at an offset."""
    found = Parser(data, pos, resolve).value()
    if isinstance(found, _Mark):
        raise PdfError("no value", pos, data)
    return found


# Content-stream operators and the names of what they do.
ALIASES = {
    "w": "setLineWidth", "J": "setLineCap", "j": "setLineJoin", "M": "setMiterLimit", "d": "setDashPattern",
    "ri": "setRenderingIntent", "i": "setFlatnessTolerance", "gs": "setGraphicsStateParameters",
    "q": "pushGraphicsState", "Q": "popGraphicsState", "cm": "setCTM",
    "m": "moveTo", "l": "appendLine", "c": "appendCurve123", "v": "appendCurve23", "y": "appendCurve13",
    "h": "closePath", "re": "appendRectangle",
    "S": "stroke", "s": "closeAndStroke", "f": "fill", "F": "fillCompat", "f*": "fillEvenOdd",
    "B": "fillThenStroke", "B*": "fillThenStrokeEvenOdd", "b": "closeAndFillThenStroke",
    "b*": "closeAndFillThenStrokeEvenOdd", "n": "closePathNoop", "W": "clip", "W*": "clipEvenOdd",
    "BT": "startTextBlock", "ET": "endTextBlock",
    "Tc": "setCharSpacing", "Tw": "setWordSpacing", "Tz": "setHorizontalScale", "TL": "setLeading",
    "Tf": "setFont", "Tr": "setRenderingMode", "Ts": "setRise",
    "Td": "adjustCurrentPosition", "TD": "adjustCurrentPositionWithLeading", "Tm": "setTextMatrix", "T*": "newLine",
    "Tj": "showString", "TJ": "showStrings", "'": "newLineAndShowString", '"': "newLineAndShowStringWithSpacing",
    "d0": "setType3FontCharWidthShapeColor", "d1": "setType3FontCharWidthShape",
    "CS": "setStrokeColorSpace", "cs": "setFillColorSpace", "SC": "setStrokeColorSpace2", "SCN": "setStrokeColorSpace3",
    "sc": "setFillColorSpace2", "scn": "setFillColorSpace3", "G": "setStrokeGray", "g": "setFillGray",
    "RG": "setStrokeColor", "rg": "setFillColor", "K": "setStrokeCMYK", "k": "setFillCMYK", "sh": "shadingPattern",
    "BI": "beginInlineImage", "EI": "endInlineImage", "Do": "drawObject",
    "MP": "designatedMarkedContentPoint", "DP": "designatedMarkedContentPointProperties",
    "BMC": "beginMarkedContent", "BDC": "beginMarkedContentWithDictionary", "EMC": "endMarkedContent",
    "BX": "beginCompatibility", "EX": "endCompatibility",
}
#: Operators that decide what text is shown and where; all others can be left out before text is extracted.
TEXT_OPERATORS = frozenset("q Q cm BT ET Tc Tw Tz TL Tf Ts Td TD Tm T* Tj TJ ' \" Do".split())

_IMAGE_END = re.compile(rb"(?<=[\x00\t\n\x0c\r ])EI(?=[\x00\t\n\x0c\r ]|\Z)")


class Operation(NamedTuple):
    operands: list
    operator: str
    alias: str | None


def parse_content(data: bytes) -> list[Operation]:
    """Operations of a content stream, each with the operands before it. Unknown operators have no alias."""
    out: list[Operation] = []
    parser = Parser(data)
    operands: list = []
    open_: list[tuple[str, list]] = []
    while True:
        if m := _PLAIN.match(data, parser.pos):
            parser.pos = m.end()
            if (number := m[1]) is not None:
                operands.append(float(number) if b"." in number else int(number))
                continue
            t = Word(m[2].decode("latin-1"))
        else:
            t = parser.token(references=False)
        if isinstance(t, _Mark):
            if t.kind == "end":
                return out
            if t.kind in ("<<", "["):
                open_.append((t.kind, operands))
                operands = []
                continue
            if t.kind in ("{", "}") or not open_:
                continue
            kind, outer = open_.pop()
            t = operands if kind == "[" else {str(k): v for k, v in zip(operands[::2], operands[1::2], strict=False)}
            operands = outer
        if isinstance(t, Word):
            if t in ("true", "false", "null"):
                operands.append({"true": True, "false": False, "null": None}[t])
                continue
            if t == "ID":  # what follows is binary, up to EI as a token
                m = _IMAGE_END.search(data, parser.pos)
                parser.pos = m.end() if m else len(data)
                t = Word("EI")
            out.append(Operation(operands, str(t), ALIASES.get(t)))
            operands = []
        else:
            operands.append(t)


def tagged(value: Any) -> Any:
    """A JSON-ready form that tells names, strings and references apart."""
    if isinstance(value, Indirect):
        return {"$ref": [value.ref.number, value.ref.generation], "value": tagged(value.value)}
    if isinstance(value, Stream):
        return {"$dict": tagged(value.dictionary), "$stream": len(value.data)}
    if isinstance(value, Ref):
        return {"$ref": [value.number, value.generation]}
    if isinstance(value, bytes):
        return {"$bin": base64.b64encode(value).decode("ascii")}
    if isinstance(value, list):
        return [tagged(x) for x in value]
    if isinstance(value, dict):
        return {k: tagged(x) for k, x in value.items()}
    return value
