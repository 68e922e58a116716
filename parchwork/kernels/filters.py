"""Stream filters: bytes to bytes."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import Any

import numpy as np

from parchwork.kernels.objects import PdfError

_BLANK = re.compile(rb"[\x00\t\n\x0c\r ]+")
_OUTSIDE_85 = re.compile(rb"[^!-u]")
#: ASCII85 groups that are worked on at once.
_GROUPS = 1 << 16


def ascii85_decode(data: bytes) -> bytes:
    """ASCII base 85. ``z`` is four zero bytes; ``~>`` ends, and only blanks may follow it."""
    body, end, rest = data.partition(b"~>")
    if end and _BLANK.sub(b"", rest):
        raise PdfError("bytes after the end of ASCII85 data", len(body) + 2, data)
    body = _BLANK.sub(b"", body)
    runs = body.split(b"z")
    for i, run in enumerate(runs):
        if len(run) % 5 and i < len(runs) - 1:
            raise PdfError("z inside a group of ASCII85 data")
        if _OUTSIDE_85.search(run):
            raise PdfError("byte outside the ASCII85 alphabet")
    short = -len(runs[-1]) % 5
    groups = np.frombuffer(b"!!!!!".join(runs) + b"u" * short, np.uint8).reshape(-1, 5)
    decoded = b"".join(_words_of(groups[at : at + _GROUPS]) for at in range(0, len(groups), _GROUPS))
    return decoded[: len(decoded) - short]


def _words_of(groups: np.ndarray) -> bytes:
    """The four bytes of each group of five digits."""
    return ((groups.astype(np.int64) - 33) @ np.array([85**4, 85**3, 85**2, 85, 1]) & 0xFFFFFFFF).astype(">u4").tobytes()


def asciihex_decode(data: bytes) -> bytes:
    """Hexadecimal digits up to ``>``; an odd last digit is a high half."""
    digits = _BLANK.sub(b"", data.partition(b">")[0])
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise PdfError("byte that is no hexadecimal digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def undo_predictor(data: bytes, parms: dict) -> bytes:
    """Undo PNG row predictors (10 and above) or the TIFF one (2, for 8-bit components)."""
    predictor = parms.get("Predictor") or 1
    if predictor == 1:
        return data
    colors, bits, columns = parms.get("Colors") or 1, parms.get("BitsPerComponent") or 8, parms.get("Columns") or 1
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        if bits != 8:
            raise PdfError(f"TIFF predictor with {bits} bits is not supported")
        rows = [bytearray(data[i : i + width]) for i in range(0, len(data), width)]
        for row in rows:
            for i in range(step, len(row)):
                row[i] = (row[i] + row[i - step]) & 255
        return b"".join(rows)
    if predictor < 10:
        raise PdfError(f"predictor {predictor} is not supported")
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            row[i] = (row[i] + (0, left, up, (left + up) // 2, _paeth(left, up, corner))[kind if kind < 5 else 0]) & 255
        out += row
        above = bytes(row) + bytes(width - len(row))
    return bytes(out)


def flate_decode(data: bytes, parms: dict | None = None) -> bytes:
    """Inflate, then undo the predictor. What a truncated stream holds is kept."""
    worker = zlib.decompressobj()
    try:
        out = worker.decompress(data) + worker.flush()
    except zlib.error as error:
        raise PdfError(f"malformed Flate data ({error})") from error
    return undo_predictor(out, parms or {})


class BitReader:
    """Big-endian numbers of any width from bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return 8 * len(self.data) - self.at

    def peek(self, n: int) -> int:
        lo, hi = self.at // 8, (self.at + n + 7) // 8
        return int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n) & (1 << n) - 1

    def next(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


CLEAR, END = 256, 257


#: What codes of a single byte, and the two marks, stand for.
_BYTES = [bytes([i]) for i in range(256)] + [b"", b""]
#: LZW codes that are cut out or put together at once.
_CODES = 1 << 12


@lru_cache
def _widths(early: int) -> np.ndarray:
    """Widths of the codes after a clear code; the last holds for all further ones."""
    return np.array([9] + [min(12, max(9, (size + early).bit_length())) for size in range(258, 4097)])


def lzw_decode(data: bytes, parms: dict | None = None) -> bytes:
    """LZW with codes of 9 to 12 bits. A missing first clear code or end code is no error."""
    widths = _widths((parms or {}).get("EarlyChange", 1))
    raw, end = np.frombuffer(data + b"\0\0\0", np.uint8), 8 * len(data)
    out: list[bytes] = []
    table = _BYTES.copy()
    size, last, at = 258, b"", 0
    done, many = 0, 64  # codes since the last clear code, codes to cut out next
    while True:
        width = widths[np.minimum(np.arange(done, done + many), len(widths) - 1)]
        ends = at + np.cumsum(width)
        width, ends = width[: (n := np.searchsorted(ends, end, "right"))], ends[:n]
        if not n:
            break
        lo, shift = (ends - width) >> 3, 24 - ((ends - width) & 7) - width
        codes = (raw[lo].astype(np.int64) << 16 | raw[lo + 1].astype(np.int64) << 8 | raw[lo + 2]) >> shift & (1 << width) - 1
        marks = np.flatnonzero(codes >> 1 == CLEAR >> 1)
        for code in codes[: marks[0] if len(marks) else n].tolist():
            if code < size:
                entry = table[code]
            elif code == size and last:
                entry = last + last[:1]
            else:
                raise PdfError(f"LZW code {code} before it is defined")
            out.append(entry)
            if last and size < 4096:
                table.append(last + entry[:1])
                size += 1
            last = entry
        if not len(marks):
            done, many, at = done + n, min(_CODES, 2 * many), int(ends[-1])
        elif codes[marks[0]] == END:
            break
        else:
            many = max(64, min(_CODES, int(marks[0])))
            del table[258:]
            size, last, done, at = 258, b"", 0, int(ends[marks[0]])
    return undo_predictor(b"".join(out), parms or {})


def lzw_encode(data: bytes) -> bytes:
    """The inverse of :func:`lzw_decode`, with early change."""
    codes = [CLEAR << 8]  # times 256, so that a run's code and the byte after it make one number
    table: dict[int, int] = {}
    get, put, size = table.get, codes.append, 258
    run = data[0] << 8 if data else END << 8
    for b in data[1:]:
        longer = get(run | b)
        if longer is not None:
            run = longer
            continue
        put(run)
        if size == 4094:
            put(CLEAR << 8)
            table.clear()
            size = 258
        else:
            table[run | b] = size << 8
            size += 1
        run = b << 8
    put(run)
    if data:
        put(END << 8)
    return _packed(np.array(codes) >> 8)


def _packed(codes: np.ndarray) -> bytes:
    """Codes, the first of which clears, as bits; the decoder's table is one entry behind."""
    out, held, at = [], np.empty(0, np.uint8), np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(codes == CLEAR, at, 0))
    since[1:] = since[:-1].copy()  # a clear code has the width of what it ends
    since[0] = 0
    for k in range(0, len(codes), _CODES):
        width = _FULL[258 + since[k : k + _CODES]]
        bits = np.unpackbits(codes[k : k + _CODES].astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
        held = np.concatenate([held, bits[np.arange(16) >= 16 - width[:, None]]])
        whole = len(held) & ~7
        out.append(np.packbits(held[:whole]).tobytes())
        held = held[whole:]
    return b"".join(out) + np.packbits(held).tobytes()


#: The width of an encoder's code, by the size of its table.
_FULL = np.array([min(12, max(9, size.bit_length())) for size in range(4097)])


def ascii85_encode(data: bytes) -> bytes:
    """The inverse of :func:`ascii85_decode`, with an end mark."""
    whole = len(data) & ~3
    words = np.frombuffer(data, ">u4", whole >> 2)
    body = b"".join(_digits_of(words[at : at + _GROUPS]) for at in range(0, len(words), _GROUPS))
    if rest := data[whole:]:  # as many digits as bytes and one; zeros here are no z
        last = int.from_bytes(rest.ljust(4, b"\0"), "big")
        body += bytes(last // 85**k % 85 + 33 for k in range(4, 3 - len(rest), -1))
    return body + b"~>"


def _digits_of(words: np.ndarray) -> bytes:
    """Five digits for each word, or ``z`` for 0."""
    digits = np.empty((len(words), 5), np.uint8)
    rest = words.astype(np.int64)
    zero = rest == 0
    for k in range(4, -1, -1):
        rest, digit = np.divmod(rest, 85)
        digits[:, k] = digit + 33
    if not zero.any():
        return digits.tobytes()
    kept = np.ones(digits.shape, bool)
    kept[zero, 1:] = False
    digits[zero, 0] = ord("z")
    return digits[kept].tobytes()


def as_list(value: Any) -> list:
    """None as no items, a list as it is, anything else as one item."""
    return [] if value is None else value if isinstance(value, list) else [value]


DECODERS = {
    "ASCII85Decode": lambda data, parms: ascii85_decode(data),
    "ASCIIHexDecode": lambda data, parms: asciihex_decode(data),
    "FlateDecode": flate_decode,
    "LZWDecode": lzw_decode,
    "A85": lambda data, parms: ascii85_decode(data),
    "AHx": lambda data, parms: asciihex_decode(data),
    "Fl": flate_decode,
    "LZW": lzw_decode,
}


def apply_filters(data: bytes, filters: Any, parms: Any = None) -> bytes:
    """Undo filters from left to right; an unknown one is an error."""
    names, settings = as_list(filters), as_list(parms)
    for i, name in enumerate(names):
        if str(name) not in DECODERS:
            raise PdfError(f"unsupported filter {name}")
        given = settings[i] if i < len(settings) and isinstance(settings[i], dict) else {}
        data = DECODERS[str(name)](data, given)
    return data
