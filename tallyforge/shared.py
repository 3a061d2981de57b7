"""Tables written once to the folder that driver and executors share, so that what follows sees one and the same data."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULT_FOLDER = "tallyforge-scratch"
#: The setting that bounds the batches Python gets, and what it is lowered to.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local masters (tests) get a folder of the machine; others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = f"file://{tempfile.gettempdir()}/{DEFAULT_FOLDER}"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared one; all of them go when the driver ends."""
    home = f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}-tables"
    if home not in _homes:
        _homes.add(home)
        atexit.register(remove, spark, home)
    return f"{home}/{uuid.uuid4().hex}/{name}"


def located(spark: SparkSession, path: str):
    """A path and its file system, through Spark's own layer (any store)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session still runs."""
    if spark.sparkContext._jsc is not None:
        where, fs = located(spark, path)
        fs.delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: lineage ends there, and every reader sees the same rows."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, so that memory doesn't grow with the length of texts or the tasks before.

    The session's batches hold BATCH_BYTES or one row from now on, unless they are smaller already; and after work its
    worker, which lives on, gives what it no longer uses back to the system.
    """
    conf = SparkSession.active().conf
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", conf.get(ARROW_BYTES, "64m").lower())
    if not found or not 0 < int(found[1]) << 10 * " kmgtp".index(found[2] or " ") <= BATCH_BYTES:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return run
