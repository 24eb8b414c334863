"""Tables written to the shared folder, so that lineage ends and a lost executor re-reads files."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a folder of its own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="classlake-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of a few MB, unless the session has a bound of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "8m")


def release() -> None:
    """Hand memory that a task no longer needs back to the system: workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, releasing memory when a task is through with it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders by the values of ``by``."""
    spark = df.sparkSession
    path = new_path(spark)
    with cleaned_shuffles(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark).removeprefix("file:").lstrip("/")
        for name in {f.split(root, 1)[1].strip("/").split("/")[0] for f in df.inputFiles() if root in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
