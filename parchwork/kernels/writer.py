"""A small PDF writer, for fixtures and round trips."""

from __future__ import annotations

import zlib

from parchwork.kernels.filters import ascii85_encode, lzw_encode


def escaped(text: bytes) -> bytes:
    """A literal string."""
    return b"(" + text.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def encoded(data: bytes, filters: tuple[str, ...]) -> tuple[bytes, bytes]:
    """Data under filters (named in decoding order), and the dictionary entry that says so."""
    for f in reversed(filters):
        data = {"FlateDecode": zlib.compress, "LZWDecode": lzw_encode, "ASCII85Decode": ascii85_encode, "ASCIIHexDecode": lambda d: d.hex().encode() + b">"}[f](data)
    names = b" ".join(b"/" + f.encode() for f in filters)
    return data, b" /Filter [" + names + b"]" if filters else b""


def stream(data: bytes, extra: bytes = b"", filters: tuple[str, ...] = ()) -> bytes:
    data, entry = encoded(data, filters)
    return b"<< /Length %d%s%s >>\nstream\n" % (len(data), entry, extra) + data + b"\nendstream"


def file_of(objects: dict[int, bytes], root: int, info: int | None = None, xref: str = "table", packed: tuple[int, ...] = ()) -> bytes:
    """A file of numbered objects. ``xref`` is ``table`` or ``stream``; ``packed`` objects go into an object stream (with ``stream`` only)."""
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    where: dict[int, tuple[int, int, int]] = {}
    objects = dict(objects)
    if packed:
        header, body = [], bytearray()
        for n in packed:
            header.append(f"{n} {len(body)}")
            body += objects.pop(n) + b" "
        head = " ".join(header).encode() + b" "
        holder = max([*objects, *packed]) + 1
        objects[holder] = stream(head + bytes(body), b" /Type /ObjStm /N %d /First %d" % (len(packed), len(head)), ("FlateDecode",))
        where |= {n: (2, holder, i) for i, n in enumerate(packed)}
    for n, body in sorted(objects.items()):
        where[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    trailer = b"/Root %d 0 R" % root + (b" /Info %d 0 R" % info if info else b"")
    start = len(out)
    if xref == "stream":
        own = max(where) + 1
        where[own] = (1, start, 0)
        rows = b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in [where.get(n, (0, 0, 0)) for n in range(own + 1)])
        out += b"%d 0 obj\n" % own + stream(rows, b" /Type /XRef /Size %d /W [1 4 2] " % (own + 1) + trailer, ("FlateDecode",)) + b"\nendobj\n"
    else:
        size = max(where) + 1
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d %05d %s \n" % ((where[n][1], 0, b"n") if n in where else (0, 65535, b"f")) for n in range(size))
        out += b"trailer\n<< /Size %d " % size + trailer + b" >>\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def paged_file(pages: list[list[list[tuple[float, float, float, str]]]], filters: tuple[str, ...] = ("FlateDecode",), xref: str = "table", width: float = 612, height: float = 792, packed: bool = False) -> bytes:
    """A file of pages of lines of (x, y from the top, font size, text). Texts go through WinAnsi; every glyph is 500 wide."""
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] /FontDescriptor << /Type /FontDescriptor /FontName /Own /MissingWidth 500 >> >>" % b" ".join([b"500"] * 256)
    kids, n = [], 4
    for lines in pages:
        content = [b"BT"]
        for line in lines:
            for x, y, size, text in line:
                content.append(b"/F1 %s Tf 1 0 0 1 %s %s Tm %s Tj" % (_n(size), _n(x), _n(height - y), escaped(text.encode("cp1252", "replace"))))
        content.append(b"ET")
        objects[n] = stream(b"\n".join(content), filters=filters)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % n
        kids.append(n + 1)
        n += 2
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 %s %s] /Kids [%s] >>" % (len(kids), _n(width), _n(height), b" ".join(b"%d 0 R" % k for k in kids))
    return file_of(objects, 1, xref=xref, packed=(1, 2, 3) if packed else ())


def _n(x: float) -> bytes:
    return f"{x:.10f}".rstrip("0").rstrip(".").encode()
