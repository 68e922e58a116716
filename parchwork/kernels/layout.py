"""The layout of one document: spans to lines, words, columns, paragraphs, sections and running text.

The rules are those of ``operators.layout`` and ``operators.sections``, for a
document that one row holds: its spans are arrays, in order, and what is made
of them depends on nothing outside the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from typing import NamedTuple

import numpy as np

from parchwork.kernels.blanks import is_blank


class Spans(NamedTuple):
    """The spans of a page, in order."""

    min_x: np.ndarray
    min_y: np.ndarray
    max_x: np.ndarray
    max_y: np.ndarray
    font_size: np.ndarray
    font_bold: np.ndarray
    text: list[str]


def line_begins(tops: list[float], dy: float = 5.0) -> list[int]:
    """Where lines begin: at a span whose top is more than ``dy`` from the least top of the line so far."""
    found: list[int] = []
    top: float | None = None
    for i, y in enumerate(tops):
        if top is None or abs(y - top) > dy:
            found.append(i)
            top = y
        elif y < top:
            top = y
    return found


def _lengths(begins: np.ndarray, n: int) -> np.ndarray:
    return np.diff(begins, append=n)


def _within(begins: np.ndarray, n: int) -> np.ndarray:
    """For n things, the number of the run of ``begins`` that holds each."""
    return np.repeat(np.arange(len(begins)), _lengths(begins, n))


def _gap(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each interval from the one before; 0 where they touch or overlap."""
    return np.maximum(0.0, np.maximum(low[1:] - high[:-1], low[:-1] - high[1:]))


class Page:
    """What is found on a page. ``lines``, ``words`` and ``paragraphs`` are where each begins: at a span, at a span and at a line."""

    def __init__(self, spans: Spans, line_dy: float = 5.0, space_width: float = 1.0, dx: float = 0.0, dy: float = 5.0, indent: float = 5.0):
        self.spans, self.line_dy, self.space_width, self.dx, self.dy, self.indent = spans, line_dy, space_width, dx, dy, indent
        self.n = len(spans.text)

    @cached_property
    def lines(self) -> np.ndarray:
        return np.array(line_begins(self.spans.min_y.tolist(), self.line_dy), np.int64)

    @cached_property
    def line_id(self) -> np.ndarray:
        """Of each span."""
        return _within(self.lines, self.n)

    @cached_property
    def words(self) -> np.ndarray:
        """A new word begins with a line, and more than ``space_width`` after the span before."""
        new = np.ones(self.n, bool)
        new[1:] = self.spans.min_x[1:] - self.spans.max_x[:-1] > self.space_width
        new[self.lines] = True
        return np.flatnonzero(new)

    @cached_property
    def word_line(self) -> np.ndarray:
        """The line of each word."""
        return self.line_id[self.words]

    @cached_property
    def word_id(self) -> np.ndarray:
        """Of each word, counted within its line."""
        return np.arange(len(self.words)) - np.searchsorted(self.words, self.lines)[self.word_line]

    @cached_property
    def word_texts(self) -> list[str]:
        """The spans' texts of each word, joined."""
        text = self.spans.text
        if len(self.words) == self.n:
            return text
        at = [*self.words.tolist(), self.n]
        return ["".join(text[a:b]) for a, b in zip(at, at[1:])]

    @cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """min_x, min_y, max_x and max_y of each line."""
        s, at = self.spans, self.lines
        if not self.n:
            return s.min_x, s.min_y, s.max_x, s.max_y
        return np.minimum.reduceat(s.min_x, at), np.minimum.reduceat(s.min_y, at), np.maximum.reduceat(s.max_x, at), np.maximum.reduceat(s.max_y, at)

    @cached_property
    def column_id(self) -> np.ndarray:
        """Of each line: a new column begins where a line is farther than ``dx`` or ``dy`` from the line before."""
        x0, y0, x1, y1 = self.boxes
        new = np.zeros(len(self.lines), np.int64)
        new[1:] = (_gap(x0, x1) > self.dx) | (_gap(y0, y1) > self.dy)
        return np.cumsum(new)

    @cached_property
    def paragraph_id(self) -> np.ndarray:
        """Of each line: a paragraph begins with a column and where the left offset differs by more than ``indent`` from the column's median, or of two lines from the second's."""
        if not self.n:
            return np.zeros(0, np.int64)
        x, column = self.boxes[0], self.column_id
        begins = np.flatnonzero(np.diff(column, prepend=-1))
        n = _lengths(begins, len(x))
        left = x - np.minimum.reduceat(x, begins)[column]
        ranked = left[np.lexsort((left, column))]
        a, b = ranked[begins + (n - 1) // 2], ranked[begins + n // 2]
        typical = np.where(a == b, a, 0.5 * a + 0.5 * b)
        typical = np.where(n == 2, left[begins + (n == 2)], typical)
        new = np.abs(typical[column] - left) > self.indent
        new[begins] = True
        return np.cumsum(new) - 1

    @cached_property
    def paragraphs(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.paragraph_id, prepend=-1))

    def classes(self, header_size: float) -> list[str]:
        """Of each paragraph: W where all spans are blank, else H where all are of header size, else B where all are bold, else N."""
        if not self.n:
            return []
        at, text = self.lines[self.paragraphs], self.spans.text
        large, bold = np.logical_and.reduceat(self.spans.font_size > header_size, at).tolist(), np.logical_and.reduceat(self.spans.font_bold, at).tolist()
        ends = [*at.tolist(), self.n]
        return ["W" if all(map(is_blank, text[a:b])) else "H" if h else "B" if o else "N" for a, b, h, o in zip(ends, ends[1:], large, bold)]

    def paragraph_texts(self) -> list[str]:
        """Words joined by spaces to lines, lines by newlines."""
        words = self.word_texts
        at = [*np.searchsorted(self.words, self.lines).tolist(), len(words)]
        lines = [" ".join(words[a:b]) for a, b in zip(at, at[1:])]
        ends = [*self.paragraphs.tolist(), len(lines)]
        return ["\n".join(lines[a:b]) for a, b in zip(ends, ends[1:])]


def header_size(sizes: np.ndarray, margin: float = 0.5, interpolate: bool = False) -> float | None:
    """The third quartile of font sizes, plus a margin."""
    n = len(sizes)
    if not n:
        return None
    if not interpolate:
        k = -(-3 * n // 4) - 1
        return float(np.partition(sizes, k)[k]) + margin
    low, rest = divmod(3 * (n - 1), 4)
    a, b = (float(v) for v in np.sort(sizes)[[low, min(low + 1, n - 1)]])
    return (a if not rest or a == b else (1 - rest / 4) * a + rest / 4 * b) + margin


def bag_of_words(words: Iterable[str]) -> Counter[str]:
    """How often each word, in lower case, occurs."""
    return Counter(map(str.lower, words))


def group_sections(classes: list[str]) -> tuple[list[int], list[str]]:
    """section_id and role of paragraphs. A section begins with a header after content; headers are titles, and so are bold and blank paragraphs until content comes."""
    ids, roles, section, prior = [], [], 0, None
    for c in classes:
        section += c == "H" and prior == "N"
        ids.append(section)
        roles.append("title" if c == "H" or (c in "BW" and prior != "N") else "body")
        if c in "HN":
            prior = c
    return ids, roles


_HYPHEN = re.compile(r"(\w+)-\n(\w+)", re.ASCII)


def unwrap(text: str, bag: dict[str, int]) -> str:
    """Lines joined by newlines to running text; whether a hyphen at a line end stays is settled as ``operators.sections.unwrap_lines`` says."""

    def one(m: re.Match) -> str:
        left, right = m[1], m[2]
        dashed, joined = (bag.get(w.lower(), 0) for w in (f"{left}-{right}", left + right))
        if dashed != joined:
            stays = dashed > joined
        else:
            stays = right[0] == right[0].upper() or bag.get(left.lower(), 0) + bag.get(right.lower(), 0) > 2
        return f"{left}-{right}" if stays else left + right

    if "-\n" in text:
        text = _HYPHEN.sub(one, text)
    return text.replace("\n", " ")


def paper(pages: list[Page], normal, interpolate: bool = False) -> list[tuple[str, list[str]]]:
    """A document's sections as (title, paragraphs); they run on across pages. ``normal`` is what becomes of a text; a document without paragraphs has one empty section."""
    pages = [p for p in pages if p.n]
    if not pages:
        return [("", [])]
    bag = Counter()
    for p in pages:
        bag.update(map(str.lower, p.word_texts))
    size = header_size(np.concatenate([p.spans.font_size for p in pages]), interpolate=interpolate)
    classes = [c for p in pages for c in p.classes(size)]
    ids, roles = group_sections(classes)
    found: list[tuple[list[str], list[str]]] = [([], []) for _ in range(ids[-1] + 1)]
    for section, role, text in zip(ids, roles, (t for p in pages for t in p.paragraph_texts()), strict=True):
        found[section][role == "body"].append(normal(unwrap(text, bag)))
    return [(" ".join(titles), texts) for titles, texts in found]


def paper_text(sections: list[tuple[str, list[str]]]) -> str:
    """``# title`` and the paragraphs, each on a line; an empty line between sections."""
    return "\n\n".join("# " + title + "\n" + "\n".join(paragraphs) for title, paragraphs in sections)
