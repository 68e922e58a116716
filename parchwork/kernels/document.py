"""A PDF file's structure: cross-references, trailers, objects and pages."""

from __future__ import annotations

import re
from functools import cached_property
from typing import Any, NamedTuple

from parchwork.kernels.filters import apply_filters, as_list
from parchwork.kernels.objects import Indirect, Name, Parser, PdfError, Ref, Stream, parse_value


class XrefEntry(NamedTuple):
    object_number: int
    generation_number: int
    in_use: bool
    offset: int | None = None
    container: int | None = None
    index: int | None = None


_START = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d+)")
_SECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+(?=\d{10} \d{5} [fn]|\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]|trailer)")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{10}) (\d{5}) ([fn])")


def xref_table(data: bytes, pos: int = 0) -> tuple[list[XrefEntry], int]:
    """Entries of all subsections after the keyword ``xref`` (which may be left out), and where they end."""
    m = re.compile(rb"[\x00\t\n\x0c\r ]*(?:xref)?").match(data, pos)
    pos, out = m.end(), []
    while m := _SECTION.match(data, pos):
        first, count, pos = int(m[1]), int(m[2]), m.end()
        for i in range(count):
            e = _ENTRY.match(data, pos)
            if not e:
                raise PdfError("malformed cross-reference entry", pos, data)
            used = e[3] == b"n"
            out.append(XrefEntry(first + i, int(e[2]), used, int(e[1])))
            pos = e.end()
    return out, pos


def xref_stream(stream: Stream) -> list[XrefEntry]:
    """Entries of a cross-reference stream. A field of width 0 has its default: type 1, else 0."""
    d = stream.dictionary
    rows = apply_filters(stream.data, d.get("Filter"), d.get("DecodeParms"))
    widths = d["W"]
    index = d.get("Index") or [0, d["Size"]]
    numbers = [n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count)]
    out, size = [], sum(widths)
    for i, number in enumerate(numbers):
        row, at, fields = rows[i * size : (i + 1) * size], 0, []
        if len(row) < size:
            raise PdfError("cross-reference stream is too short")
        for k, width in enumerate(widths):
            fields.append(int.from_bytes(row[at : at + width], "big") if width else int(k == 0))
            at += width
        kind, a, b = fields
        if kind == 1:
            out.append(XrefEntry(number, b, True, a))
        elif kind == 2:
            out.append(XrefEntry(number, 0, True, None, a, b))
        else:
            out.append(XrefEntry(number, b, False, a))
    return out


class Page(NamedTuple):
    number: int
    ref: Ref
    dictionary: dict
    media_box: list[float] | None
    resources: Any


class Document:
    """One file. Sections, and the trailers with them, run from newest to oldest.

    ``trailer_precedence`` says whose keys win in the merged trailer: the
    ``newest`` section's, as the format has it, or the ``oldest``'s.
    """

    def __init__(self, data: bytes, trailer_precedence: str = "newest"):
        self.data, self.trailer_precedence = data, trailer_precedence
        self._objects: dict[Ref, Any] = {}
        self._opening: set[Ref] = set()
        self._containers: dict[int, list[tuple[int, Any]]] = {}

    # -- cross-references --------------------------------------------------------------

    @cached_property
    def sections(self) -> list[tuple[list[XrefEntry], dict]]:
        at = self.data.rfind(b"startxref")
        m = _START.match(self.data, at) if at >= 0 else None
        if not m:
            raise PdfError("no startxref")
        pos, seen, out = int(m[1]), set(), []
        pending = [pos]
        while pending:
            pos = pending.pop(0)
            if pos in seen:  # a chain that bites its tail ends
                continue
            seen.add(pos)
            entries, trailer = self._section(pos)
            out.append((entries, trailer))
            pending += [p for p in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(p, int)]
        return out

    def _section(self, pos: int) -> tuple[list[XrefEntry], dict]:
        if pos >= len(self.data):
            raise PdfError("cross-reference section beyond the end", pos)
        if re.compile(rb"[\x00\t\n\x0c\r ]*xref").match(self.data, pos):
            entries, end = xref_table(self.data, pos)
            m = re.compile(rb"[\x00\t\n\x0c\r ]*trailer").match(self.data, end)
            if not m:
                raise PdfError("cross-reference table without a trailer", end, self.data)
            trailer = parse_value(self.data, m.end())
            return entries, trailer
        found = parse_value(self.data, pos)
        if not isinstance(found, Indirect) or not isinstance(found.value, Stream):
            raise PdfError("neither a cross-reference table nor a stream", pos, self.data)
        return xref_stream(found.value), found.value.dictionary

    @cached_property
    def xref(self) -> list[tuple[int, int, XrefEntry]]:
        """(section, place in it, entry), newest section first."""
        return [(s, i, e) for s, (entries, _) in enumerate(self.sections) for i, e in enumerate(entries)]

    @cached_property
    def _in_use(self) -> dict[Ref, XrefEntry]:
        found: dict[Ref, XrefEntry] = {}
        for _, _, e in self.xref:
            if e.in_use:  # the newest entry in use counts, even if a newer one frees the object
                found.setdefault(Ref(e.object_number, e.generation_number), e)
        return found

    @cached_property
    def trailer(self) -> dict:
        newest_last = [t for _, t in reversed(self.sections)]
        merged: dict = {}
        for t in newest_last if self.trailer_precedence == "newest" else reversed(newest_last):
            merged |= t
        return merged

    # -- objects -----------------------------------------------------------------------

    def entry(self, ref: Ref) -> XrefEntry:
        found = self._in_use.get(ref)
        if found is None:
            raise PdfError(f"no cross-reference in use for {ref}")
        return found

    def object(self, ref: Ref) -> Any:
        """The object that a reference names."""
        ref = Ref(*ref)
        if ref in self._objects:
            return self._objects[ref]
        if ref in self._opening:
            raise PdfError(f"object {ref} needs itself")
        self._opening.add(ref)
        try:
            e = self.entry(ref)
            if e.container is not None:
                contents = self.container(e.container)
                if e.index is None or e.index >= len(contents):
                    raise PdfError(f"object stream {e.container} has no object at {e.index}")
                number, value = contents[e.index]
            else:
                found = Parser(self.data, e.offset, self.object).value()
                if not isinstance(found, Indirect):
                    raise PdfError("no object where the cross-reference points", e.offset, self.data)
                number, value = found.ref.number, found.value
            if number != ref.number:
                raise PdfError(f"object {number} where {ref.number} should be")
        finally:
            self._opening.discard(ref)
        self._objects[ref] = value
        return value

    def container(self, number: int) -> list[tuple[int, Any]]:
        """(object number, value) of an object stream, in order."""
        if number not in self._containers:
            stream = self.object(Ref(number, 0))
            if not isinstance(stream, Stream):
                raise PdfError(f"object {number} is no object stream")
            data, first = self.decoded(stream), stream.dictionary["First"]
            header = [int(x) for x in data[:first].split()]
            self._containers[number] = [(n, parse_value(data, first + at)) for n, at in zip(header[::2], header[1::2], strict=True)]
        return self._containers[number]

    def resolve(self, value: Any) -> Any:
        """A value with references at its top followed."""
        seen = set()
        while isinstance(value, Ref):
            if value in seen:
                raise PdfError(f"reference {value} leads to itself")
            seen.add(value)
            value = self.object(value)
        return value

    def get(self, dictionary: dict | Stream | None, key: str) -> Any:
        if isinstance(dictionary, Stream):
            dictionary = dictionary.dictionary
        return self.resolve((dictionary or {}).get(key))

    def decoded(self, stream: Stream) -> bytes:
        filters = [self.resolve(f) for f in as_list(self.get(stream, "Filter"))]
        parms = [self.resolve(p) for p in as_list(self.get(stream, "DecodeParms"))]
        return apply_filters(stream.data, filters, [{k: self.resolve(v) for k, v in p.items()} if isinstance(p, dict) else p for p in parms])

    # -- pages -------------------------------------------------------------------------

    @cached_property
    def catalog(self) -> dict:
        found = self.get(self.trailer, "Root")
        if not isinstance(found, dict):
            raise PdfError("no catalog")
        return found

    @cached_property
    def info(self) -> dict | None:
        return self.get(self.trailer, "Info")

    @cached_property
    def pages(self) -> list[Page]:
        """The leaves of the page tree, depth first. MediaBox and Resources come from the nearest ancestor that has them."""
        out: list[Page] = []
        stack: list[tuple[Any, Any, Any, frozenset]] = [(self.catalog.get("Pages"), None, None, frozenset())]
        while stack:
            ref, box, resources, above = stack.pop()
            if isinstance(ref, Ref):
                if ref in above:
                    raise PdfError(f"page tree node {ref} is its own ancestor")
                above = above | {ref}
            node = self.resolve(ref)
            if not isinstance(node, dict):
                raise PdfError("page tree node is no dictionary")
            box, resources = self.get(node, "MediaBox") or box, self.get(node, "Resources") or resources
            kids = self.get(node, "Kids")
            if node.get("Type") == "Pages" or (kids is not None and node.get("Type") != "Page"):
                stack += [(k, box, resources, above) for k in reversed(kids or [])]
            else:
                numbers = None if box is None else [float(self.resolve(x)) for x in box]
                out.append(Page(len(out) + 1, ref if isinstance(ref, Ref) else Ref(0, 0), node, numbers, resources))
        return out

    def content(self, page: Page, separator: bytes = b"\n") -> bytes:
        """The page's content streams, decoded and joined."""
        parts = [self.resolve(c) for c in as_list(self.resolve(page.dictionary.get("Contents")))]
        return separator.join(self.decoded(p) for p in parts if isinstance(p, Stream))


def type_of(value: Any) -> tuple[str | None, str | None]:
    """Type and Subtype of an object, where it has them."""
    d = value.dictionary if isinstance(value, Stream) else value
    if not isinstance(d, dict):
        return None, None
    kind, sub = d.get("Type"), d.get("Subtype")
    return str(kind) if isinstance(kind, Name) else None, str(sub) if isinstance(sub, Name) else None
