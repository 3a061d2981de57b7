"""Structured Streaming: first answers win, late ones never count, the attempt machine, exactly-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buckets
from ..shared import fresh_dir, located
from .stateful import STORE


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of files. The pattern matches the one name, be it a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def first_per_key(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """One event of each key within the watermark; state is dropped once no duplicate can come."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def answers_in_time(answers: DataFrame, closings: DataFrame, delay: str = "10 minutes", reach: str = "1 day", lanes: int = 16, span: str = "1 hour") -> DataFrame:
    """answers (a stream: poll_id, ts, ..) that came before their poll closed (a stream: poll_id, closed_at).

    A left outer join under two watermarks: an answer waits until no closing at or before it can come any more, and
    passes if there was none. A poll's closing lies within reach before the answers that it shuts out; answers are
    spread over lanes and closings are sent to all of them, so a hot poll is no task of its own. An answer without a
    time or poll never passes.

    Of a poll's closings in one span (reach at most) the first and the last tell all: an answer in the same span has
    the first before it or none, a later one lies within reach of any of them if of the last. So an answer meets two
    closings for each span of its reach, however often its poll is closed.
    """
    told = answers.where("poll_id IS NOT NULL").withWatermark("ts", delay).withColumn("_lane", F.pmod(F.xxhash64("ts"), F.lit(lanes)))
    few = closings.withWatermark("closed_at", delay).groupBy("poll_id", F.window("closed_at", span)).agg(F.min("closed_at").alias("_first"), F.max("closed_at").alias("_last"))
    few = few.select(F.col("poll_id").alias("_poll"), F.window_time("window").alias("_until"), F.explode(F.array_distinct(F.array("_first", "_last"))).alias("closed_at"))
    shut = few.withColumn("_at_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>")))
    same = (F.col("poll_id") == F.col("_poll")) & (F.col("_lane") == F.col("_at_lane"))
    before = (F.col("closed_at") <= F.col("ts")) & (F.col("closed_at") >= F.col("ts") - F.expr(f"INTERVAL {reach}"))
    known = (F.col("_until") <= F.col("ts") + F.expr(f"INTERVAL {span}")) & (F.col("_until") >= F.col("ts") - F.expr(f"INTERVAL {reach}"))  # follows from before; bounds the state
    return told.join(shut, same & before & known, "left_outer").where("closed_at IS NULL").select(*answers.columns)


def with_beat(stream: DataFrame, beats: DataFrame) -> DataFrame:
    """A stream with marks of time (beats, a stream) that hold none of its other columns; they move the watermark on, so that a stream which has no more rows gives what waits. Where rows without a key are left out, as before a join, the marks need a key of their own."""
    return stream.unionByName(beats, allowMissingColumns=True)


def beat(table: DataFrame, time: str, name: str, after: str = "30 days") -> DataFrame:
    """A stream of one mark of time, that long after the last row of a table."""
    end = table.agg((F.max(time).cast("timestamp") + F.expr(f"INTERVAL {after}")).alias(name))
    spark, folder = table.sparkSession, fresh_dir(table.sparkSession, "beat")
    end.write.parquet(folder)
    return spark.readStream.schema(end.schema).parquet(folder)


def is_written(spark: SparkSession, path: str) -> bool:
    where, fs = located(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def publish(df: DataFrame, folder: str, version: int, kept: int = 2) -> str:
    """Writes a version of a table, whole or not at all (readers look for its mark), and removes versions before the last `kept`; returns its path."""
    path = f"{folder}/v{version}"
    df.write.mode("overwrite").parquet(path)
    if version >= kept:
        where, fs = located(df.sparkSession, f"{folder}/v{version - kept}")
        fs.delete(where, True)
    return path


def merged_into(stream: DataFrame, folder: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now into a keyed table in versions (one for each batch), and reads its last one."""
    query = stream.writeStream.foreachBatch(buckets.upsert_sink(f"{folder}/table", keys, by)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return buckets.read(stream.sparkSession, f"{folder}/table")


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now into files of the shared folder, and reads them. A folder that is named goes on from where its last run stopped."""
    spark = stream.sparkSession
    folder = folder or fresh_dir(spark, name)
    was = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], was)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
