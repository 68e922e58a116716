"""Session helpers: configuration, table loading and cutting of lineage.

Everything here works on a session the caller owns; nothing starts a cluster.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows and bytes of an Arrow batch of texts or files.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000
#: Bytes of a file that one part gets where a table is dealt out, and the most parts.
PART_BYTES, MOST_PARTS = 16 << 20, 10_000
#: For Python workers: memory that Arrow and the C library let go of returns to the system.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the defaults above, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("parchwork")
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return attach(builder.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the same place as the driver.

    On a cluster the package is installed or sent with ``--py-files``; this
    only adds the checkout to the workers' search path. Rows here are whole
    texts or files, so Arrow batches are kept to ``BATCH_ROWS`` of them and to
    ``BATCH_BYTES`` unless the session says otherwise.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if (spark.conf.get(name, default) or "").removesuffix("b") == default:
            spark.conf.set(name, str(value))
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside drop their shuffle files when they have ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` in as many parts as there are cores at least, for work that takes long for each byte.

    A table in that many files stays as it is. One that comes in fewer is
    dealt out once, by ``key`` where one is given (else in turn), to parts of
    about ``PART_BYTES``: of the parts that Spark plans for a file, only those
    in which a row group begins have rows, so their number says nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if min(df.rdd.getNumPartitions(), len(df.inputFiles()) or cores) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2 * cores, min(size // PART_BYTES, MOST_PARTS))
    return df.repartition(parts, key) if key else df.repartition(parts)


def arrow_types(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return [(f.name, f.type) for f in to_arrow_schema(spark.createDataFrame([], schema).schema)]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder comes from ``spark.checkpoint.dir``. Only where that is unset,
    as in a local test, a temporary folder is used. Lost executors therefore
    cost a re-read of shared files, not the rows.
    """
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="parchwork-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def output_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that do not clash (in any case) with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
