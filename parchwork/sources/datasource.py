"""``spark.read.format("pdf").option("table", ...).load(folder)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parchwork.kernels.document import Document
from parchwork.kernels.objects import PdfError
from parchwork.sources.pdf import KERNELS, MALFORMED, SCHEMAS


#: Bytes and files that one partition takes.
PART_BYTES, PART_FILES = 64_000_000, 1000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class PdfDataSource(DataSource):
    """Tables of PDF files in a folder that driver and executors both see, with ``mode`` as for ``read_table``.

    Elsewhere use ``files`` and ``read_table``, which list and read through Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "text_spans")] + (", _error string" if self.options.get("mode") == "permissive" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.table, self.permissive = options["path"], options.get("table", "text_spans"), options.get("mode") == "permissive"
        self.columns = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        parts: list[list[str]] = [[]]
        size = 0
        for p in sorted(Path(self.folder).rglob("*.pdf")):
            if parts[-1] and (size + p.stat().st_size > PART_BYTES or len(parts[-1]) >= PART_FILES):
                parts.append([])
                size = 0
            parts[-1].append(str(p))
            size += p.stat().st_size
        return [_Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as file:
                    document = Document(file.read())
                for row in KERNELS[self.table](document, {"columns": set(self.columns)}):
                    yield (path, *row, None) if self.permissive else (path, *row)
            except MALFORMED as error:
                if not self.permissive:
                    raise PdfError(f"{path}: {error}") from error
                yield (path, *[None] * (len(self.columns) - 1), str(error))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
