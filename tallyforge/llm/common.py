"""What the training-data operators share: the shared folder, staging, word and letter rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded  # noqa: F401 - for the operators

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot from so many rows on, and from this share of all rows; so there are MOST_HOT hot keys at most.
HOT_ROWS, MOST_HOT = 1000, 1000
DEFAULT_FOLDER = "tallyforge-scratch"
_homes: set[str] = set()
_paths: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local masters (tests) get a folder of the machine; others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = f"file://{tempfile.gettempdir()}/{DEFAULT_FOLDER}"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared one; all of them go when the driver ends."""
    home = f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(forget, spark, home)
    return f"{home}/{uuid.uuid4().hex}/{name}"


def open_store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and its path there, for tasks that write files of their own."""
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing.

    Random 64-bit columns don't shrink, so the codec is the fast one that still folds repeats.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    return out


def discard(staged: DataFrame) -> None:
    """Removes a staged table that nothing reads any more; what was made from it must be staged too."""
    forget(staged.sparkSession, _paths.pop(id(staged)))


def forget(spark: SparkSession, path: str) -> None:
    """Removes a staged folder through Spark's own file system layer (any store), if the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def join_unevenly(rows: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with dim, which has a row for each key and how many rows have it (c): no task holds the rows of a hot key.

    Keys of more than 1 / MOST_HOT of the counted rows are MOST_HOT at most; their rows stay where they are and meet
    dim by broadcast. The others are joined as Spark chooses. Rows with a null key meet nothing. how: inner or left.
    """
    total = dim.agg(F.sum("c")).first()[0] or 0
    hot = dim.where(F.col("c") > F.lit(max(HOT_ROWS, total / MOST_HOT)))
    few, other = F.broadcast(hot), dim.join(F.broadcast(hot.select(*on)), on, "left_anti")
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    plain = rows.where(known)
    found = plain.join(few, on).unionByName(plain.join(F.broadcast(hot.select(*on)), on, "left_anti").join(other, on, how))
    return found if how == "inner" else found.unionByName(rows.where(~known), allowMissingColumns=True)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that learn nothing: crc32 of the id as text leaves 2 when divided by 4. Null ids hash as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
