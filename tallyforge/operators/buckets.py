"""Keyed tables in versions: rows lie in buckets by the hash of their key, and a merge rewrites the buckets that it touches.

    folder/data/v7/bucket=3/..      the rows of bucket 3 as version 7 wrote them
    folder/versions/v7              for each bucket, which data it has in version 7; its mark of success makes the version

A version is there once its list is, whole or not at all. What was written before a crash is of no list, so the
version before stays the last one, and writing it again puts it right. Buckets that a batch doesn't touch keep their data, whatever the
table's size. The number of buckets is fixed by the first version; the driver holds a row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import located, remove
from .tables import upsert

BUCKETS = 64
_LIST = "bucket int, path string, buckets int"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def is_version(spark: SparkSession, folder: str, version: int) -> bool:
    where, fs = located(spark, f"{folder}/versions/v{version}/_SUCCESS")
    return fs.exists(where)


def latest(spark: SparkSession, folder: str) -> int | None:
    """The last whole version."""
    where, fs = located(spark, f"{folder}/versions")
    found = [int(f.getPath().getName()[1:]) for f in fs.listStatus(where)] if fs.exists(where) else []
    return max((v for v in found if is_version(spark, folder, v)), default=None)


def listed(spark: SparkSession, folder: str, version: int) -> dict[int, str]:
    """Where each bucket of a version lies; empty buckets are left out."""
    rows = spark.read.schema(_LIST).parquet(f"{folder}/versions/v{version}").collect()  # one row for each bucket
    return {r["bucket"]: r["path"] for r in rows if r["path"]}


def _size(spark: SparkSession, folder: str, version: int) -> int:
    return spark.read.schema(_LIST).parquet(f"{folder}/versions/v{version}").agg(F.max("buckets")).first()[0]


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a table, the last one if none is named."""
    version = latest(spark, folder) if version is None else version
    if version is None or not is_version(spark, folder, version):
        raise FileNotFoundError(f"{folder} has no version {'' if version is None else version}".rstrip())
    return _data(spark, folder, listed(spark, folder, version).values())


def _schema_path(folder: str) -> str:
    return f"{folder}/shape"


def _data(spark: SparkSession, folder: str, paths) -> DataFrame:
    shape = spark.read.parquet(_schema_path(folder)).schema
    paths = sorted(paths)
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def merge(batch: DataFrame, folder: str, version: int, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS, kept: int = 2) -> list[int]:
    """Puts a batch into a table by key as the next version; returns the buckets that it rewrote.

    Of a batch's rows of one key the last by `by` counts, or by all columns. A version that is there already stays as
    it is, so what runs again counts once. The version before must be there, or the table would lack what came before;
    the last `kept` versions stay. A null key meets no other.
    """
    spark = batch.sparkSession
    if is_version(spark, folder, version):
        return []
    if version and not is_version(spark, folder, version - 1):
        raise FileNotFoundError(f"version {version - 1} of {folder} is missing")
    before = listed(spark, folder, version - 1) if version else {}
    if version:
        buckets = _size(spark, folder, version - 1)
    else:
        batch.limit(0).write.mode("overwrite").parquet(_schema_path(folder))
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*(by or batch.columns))).alias("_last")).select("_last.*")
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets).alias("b")).distinct().collect())  # buckets at most
    if touched:
        old = _data(spark, folder, [before[b] for b in touched if b in before])
        merged = upsert(old, last, keys).withColumn("bucket", bucket_of(keys, buckets))
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v{version}")
    now = before | {b: f"{folder}/data/v{version}/bucket={b}" for b in touched}
    _publish(spark, folder, version, now, buckets)
    if version >= kept:
        _forget(spark, folder, version - kept, {p for v in range(version - kept + 1, version + 1) for p in (listed(spark, folder, v) if is_version(spark, folder, v) else {}).values()})
    return touched


def _publish(spark: SparkSession, folder: str, version: int, paths: dict[int, str], buckets: int) -> None:
    rows = [(b, paths.get(b), buckets) for b in range(buckets)]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/v{version}")


def _forget(spark: SparkSession, folder: str, version: int, needed: set[str]) -> None:
    """Removes a version and the data that no later one needs."""
    if is_version(spark, folder, version):
        for path in set(listed(spark, folder, version).values()) - needed:
            remove(spark, path)
        remove(spark, f"{folder}/versions/v{version}")


def upsert_sink(folder: str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS, kept: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch as the version of its number."""

    def put(batch: DataFrame, batch_id: int) -> None:
        merge(batch, folder, batch_id, keys, by, buckets, kept)

    return put
