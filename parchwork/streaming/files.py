"""PDF files as a stream: each new file is parsed once, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchwork.sources.pdf import read_table
from parchwork.session import attach


def stream_table(spark: SparkSession, folder: str, table: str, max_files: int = 1000, **options) -> DataFrame:
    """A streaming table of the files that arrive in a folder; malformed ones give error rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = attach(spark).readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", max_files).load(folder)
    return read_table(found, table, **{"mode": "permissive"} | options)
