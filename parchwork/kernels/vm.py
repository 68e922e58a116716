"""The part of the graphics machine that decides which text stands where."""

from __future__ import annotations

import logging
from copy import copy
from dataclasses import dataclass, field
from typing import NamedTuple

from parchwork.kernels.document import Document
from parchwork.kernels.fonts import Font
from parchwork.kernels.objects import TEXT_OPERATORS, Operation, PdfError, Stream, parse_content

log = logging.getLogger(__name__)

#: Forms nested this deep are not drawn.
MAX_DEPTH = 5

#: The six numbers of an affine map that vary: (x, y) goes to (a x + c y + e, b x + d y + f).
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First ``m``, then ``n``."""
    return (
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def add(m: Matrix, n: Matrix) -> Matrix:
    return tuple(a + b for a, b in zip(m, n, strict=True))  # type: ignore[return-value]


def transform_point(x: float, y: float, m: Matrix) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


class Span(NamedTuple):
    """Shown text. Vertical coordinates grow downwards from the top of the page."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    font_name: str | None
    font_size: float
    font_bold: bool
    font_italic: bool
    buffer: bytes
    text: str


@dataclass
class State:
    ctm: Matrix = IDENTITY
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    font: str | None = None
    size: float = 0.0
    rise: float = 0.0


@dataclass
class Machine:
    """Runs operations. Subclass it, or override ``show``, to do something else with shown text."""

    document: Document
    resources: dict | None
    height: float
    metrics: dict | None = None
    glyphs: dict | None = None
    spans: list[Span] = field(default_factory=list)
    state: State = field(default_factory=State)
    stack: list[State] = field(default_factory=list)
    matrix: Matrix = IDENTITY
    line: Matrix = IDENTITY
    depth: int = 0
    _fonts: dict = field(default_factory=dict)

    def font(self) -> Font:
        """The current font, looked up in the current resources."""
        name = self.state.font
        key = (id(self.resources), name)
        if key not in self._fonts:
            fonts = self.document.get(self.resources, "Font")
            found = self.document.get(fonts, name) if name is not None else None
            if not isinstance(found, dict):
                raise PdfError(f"no font {name} in the resources")
            self._fonts[key] = Font(self.document, found, self.metrics, self.glyphs)
        return self._fonts[key]

    def run(self, operations: list[Operation]) -> list[Span]:
        for operation in operations:
            if operation.operator in TEXT_OPERATORS:
                self.apply(operation)
            elif operation.alias is None:
                log.warning("unknown operator %s", operation.operator)
        return self.spans

    def apply(self, operation: Operation) -> None:
        s, x = self.state, operation.operands
        match operation.operator:
            case "q":
                self.stack.append(copy(s))
            case "Q":
                if self.stack:  # one too many is no error
                    self.state = self.stack.pop()
            case "cm":
                s.ctm = multiply(_matrix(x), s.ctm)
            case "BT":
                self.matrix = self.line = IDENTITY
            case "Tc":
                s.char_space = float(x[0])
            case "Tw":
                s.word_space = float(x[0])
            case "Tz":
                s.scale = float(x[0])
            case "TL":
                s.leading = float(x[0])
            case "Tf":
                s.font, s.size = str(x[0]), float(x[1])
            case "Ts":
                s.rise = float(x[0])
            case "Td" | "TD":
                if operation.operator == "TD":
                    s.leading = -float(x[1])
                self.next_line(float(x[0]), float(x[1]))
            case "Tm":
                self.matrix = self.line = _matrix(x)
            case "T*":
                self.next_line(0.0, -s.leading)
            case "Tj":
                self.show(x[0])
            case "'":
                self.next_line(0.0, -s.leading)
                self.show(x[0])
            case '"':
                s.word_space, s.char_space = float(x[0]), float(x[1])
                self.next_line(0.0, -s.leading)
                self.show(x[2])
            case "TJ":
                for item in x[0]:
                    if isinstance(item, bytes):
                        self.show(item)
                    elif isinstance(item, (int, float)):
                        self.advance(-float(item), 0, 0)
            case "Do":
                self.draw(str(x[0]))

    def next_line(self, x: float, y: float) -> None:
        self.line = multiply((1.0, 0.0, 0.0, 1.0, x, y), self.line)
        self.matrix = self.line

    def advance(self, width: float, chars: int, spaces: int) -> None:
        """Move on by a width in thousandths of the font size, and the spacing of characters and words."""
        s = self.state
        by = (width / 1000 * s.size + s.char_space * chars + s.word_space * spaces) * s.scale / 100
        self.matrix = multiply((1.0, 0.0, 0.0, 1.0, by, 0.0), self.matrix)

    def position(self) -> tuple[float, float]:
        return transform_point(0.0, self.state.rise, multiply(self.matrix, self.state.ctm))

    def text_size(self) -> float:
        """Font size in page units; 0 or negative for turned text."""
        m, c = self.matrix, self.state.ctm
        return (m[2] * c[1] + m[3] * c[3]) * self.state.size

    def show(self, data: bytes) -> None:
        font, (x, y), size = self.font(), self.position(), self.text_size()
        text, width = font.decode(data), font.measure(data)
        self.advance(width, len(text) if text.isascii() else len(text.encode("utf-16-be", "surrogatepass")) // 2, text.count(" "))
        end = self.position()[0]
        top = self.height - y
        self.spans.append(Span(x, top, x + (end - x), top + size, self.state.font, size, font.bold, font.italic, data, text))

    def draw(self, name: str) -> None:
        """Run a form; other external objects show no text."""
        found = self.document.get(self.document.get(self.resources, "XObject"), name)
        if not isinstance(found, Stream):
            raise PdfError(f"no external object {name} in the resources")
        if found.dictionary.get("Subtype") != "Form":
            return
        if self.depth + 1 >= MAX_DEPTH:
            log.warning("form %s is nested too deep", name)
            return
        held = self.resources, self.state, self.stack, self.matrix, self.line
        self.state, self.stack = copy(self.state), []
        matrix = self.document.get(found, "Matrix")
        if matrix:
            self.state.ctm = multiply(_matrix([self.document.resolve(v) for v in matrix]), self.state.ctm)
        self.resources = self.document.get(found, "Resources") or self.resources
        self.depth += 1
        try:
            self.run(parse_content(self.document.decoded(found)))
        finally:
            self.depth -= 1
            self.resources, self.state, self.stack, self.matrix, self.line = held


def _matrix(x: list) -> Matrix:
    return tuple(float(v) for v in x[:6])  # type: ignore[return-value]


def page_spans(document: Document, page, metrics: dict | None = None, glyphs: dict | None = None) -> list[Span]:
    """The spans of a page, in painting order."""
    box = page.media_box or [0.0, 0.0, 612.0, 792.0]
    return Machine(document, page.resources, box[3] - box[1], metrics, glyphs).run(parse_content(document.content(page)))


def form_spans(document: Document, form: Stream, resources: dict | None = None, metrics: dict | None = None, glyphs: dict | None = None) -> list[Span]:
    """The spans of a form by itself, within its bounding box. ``resources`` serve a form that has none of its own."""
    box = [float(document.resolve(v)) for v in document.get(form, "BBox") or [0.0, 0.0, 612.0, 792.0]]
    return Machine(document, document.get(form, "Resources") or resources, box[3] - box[1], metrics, glyphs).run(parse_content(document.decoded(form)))
