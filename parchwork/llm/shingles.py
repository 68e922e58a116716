"""Sets of word shingles as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parchwork.llm.caches import begin, keep

#: Words of a shingle.
WIDTH = 5
#: Bytes of text hashed at a time; a longer text is a step of its own.
STEP = 500_000

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte; A to Z have those of a to z.
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = np.random.default_rng(6).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[int, np.ndarray] = {}
keep("shingles", _tables.clear)


def _powers(n: int, base: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, STEP + 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 2 * STEP:  # the table of a very long text is not kept
            _tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
        return text_buffers(texts)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts laid end to end, and the number of words before each text."""
    base = int(offsets[0])
    data, edges = data[base : int(offsets[-1])], offsets - base
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(edges), dtype=np.int64)
    word = ~_BLANK[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first = edges[:-1][edges[:-1] < edges[1:]]  # of texts that are not empty
    begins[first] = word[first]
    final = first[1:] - 1
    ends[final] = word[final]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(n, _BASE), out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * _powers(n, _INVERSE)[begins]
    return mix(hashes + (ends - begins).astype(np.uint64)), np.searchsorted(begins, edges)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; none without words.

    A text of fewer than ``WIDTH`` words has its whole sequence as one shingle.
    """
    begin("shingles")
    data, offsets = text_buffers(texts)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1)
        words, counts = word_hashes(data, offsets[lo : hi + 1])
        n = len(words)
        grams = np.zeros(max(n - WIDTH + 1, 0), dtype=np.uint64)
        for i in range(WIDTH):
            grams += words[i : n - WIDTH + 1 + i] * _PLACE[i] if len(grams) else grams
        grams = mix(grams)
        for i in range(hi - lo):
            a, b = int(counts[i]), int(counts[i + 1])
            if b - a >= WIDTH:
                found = np.sort(grams[a : b - WIDTH + 1])
                keep = np.ones(len(found), dtype=bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield lo + i, found[keep]
            elif b > a:
                yield lo + i, mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a))
            else:
                yield lo + i, np.zeros(0, dtype=np.uint64)
        lo = hi


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a sorted set."""
    order = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(_BASE)
    terms = (mix(shingles + np.uint64(len(shingles))) ^ order) + mix(shingles * np.uint64(_INVERSE)) * np.uint64(3)
    return int(mix(terms.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
