"""Work on whole documents where they lie: one row in, its rows out, nothing dealt, sorted or gathered."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parchwork.session import arrow_types

#: Rows and bytes (of the inputs they come from) of an Arrow batch of results.
OUT_ROWS, OUT_BYTES = 50_000, 4_000_000


class Rows:
    """Columns of many documents, let go in batches of bounded size."""

    def __init__(self, types: list[tuple[str, pa.DataType]]):
        self.types = types
        self._empty()

    def _empty(self) -> None:
        self.keys, self.counts, self.columns, self.n, self.bytes = [], [], [[] for _ in self.types[1:]], 0, 0

    def add(self, key: Any, columns: Sequence[Sequence], size: int = 0) -> Iterator[pa.RecordBatch]:
        """The rows of one document: ``key`` and the items of ``columns``, made from ``size`` bytes."""
        n = len(columns[0])
        self.keys.append(key)
        self.counts.append(n)
        for held, given in zip(self.columns, columns, strict=True):
            held.append(given)
        self.n, self.bytes = self.n + n, self.bytes + size
        if self.n >= OUT_ROWS or self.bytes >= OUT_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held, and nothing if that is nothing."""
        if self.n:
            keys = pa.array(self.keys, self.types[0][1]).take(pa.array(np.repeat(np.arange(len(self.keys)), self.counts)))
            batch = pa.RecordBatch.from_arrays([keys, *[_joined(held, t) for held, (_, t) in zip(self.columns, self.types[1:], strict=True)]], names=[name for name, _ in self.types])
            self._empty()
            for at in range(0, batch.num_rows, OUT_ROWS):
                yield batch.slice(at, OUT_ROWS)
        self._empty()


def _joined(parts: list, t: pa.DataType) -> pa.Array:
    if all(isinstance(p, np.ndarray) for p in parts):
        return pa.array(np.concatenate(parts), t)
    return pa.array([v for p in parts for v in p], t)


def by_document(documents: DataFrame, make: Callable[[str], Sequence[Sequence] | None], schema: str) -> DataFrame:
    """Rows of (key, text) to rows of ``schema``, whose first column is the key: ``make`` gives the other columns, as arrays or lists of one length, from a text.

    A null text counts as an empty one. One document at a time is worked on.
    """
    types = pickle.loads(pickle.dumps(arrow_types(documents.sparkSession, schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(types)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if (columns := make(text)) is not None:
                    yield from rows.add(key, columns, len(text))
        yield from rows.rest()

    return documents.mapInArrow(run, schema)
