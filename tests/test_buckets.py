"""Keyed tables in versions: what a merge rewrites, what runs again, crashes, and what is kept."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import buckets
from tallyforge.streaming import queries as Q

SHAPE = "k long, v string, at int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(i, "old", 0) for i in range(1000)]
    assert len(buckets.merge(spark.createDataFrame(rows, SHAPE), folder, 0, ["k"], buckets=32)) == 32
    touched = buckets.merge(spark.createDataFrame([(i, "new", 1) for i in range(10)], SHAPE), folder, 1, ["k"])
    before, now = (buckets.listed(spark, folder, v) for v in (0, 1))
    assert 0 < len(touched) <= 10 and {b for b in now if now[b] != before[b]} == set(touched)
    assert rows_of(buckets.read(spark, folder)) == sorted([(i, "new", 1) if i < 10 else (i, "old", 0) for i in range(1000)], key=str)
    assert rows_of(buckets.read(spark, folder, 0)) == sorted(rows, key=str)
    assert {r["bucket"] for r in buckets.read(spark, folder).select(buckets.bucket_of(["k"], 32).alias("bucket")).collect()} == set(now)


def test_against_a_dictionary(spark, tmp_path):
    rng, folder, table = random.Random(1), str(tmp_path / "t"), {}
    for version in range(5):
        batch = [(rng.randint(0, 60), rng.choice("abc"), rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 40]))]
        for r in sorted(batch, key=lambda r: (r[2], r[1])):
            table[r[0]] = r
        buckets.merge(spark.createDataFrame(batch, SHAPE), folder, version, ["k"], ["at", "v"], buckets=5)
        assert rows_of(buckets.read(spark, folder)) == sorted(table.values(), key=str)
    assert not buckets.is_version(spark, folder, 2) and buckets.is_version(spark, folder, 3) and buckets.latest(spark, folder) == 4
    kept = {p.split("/data/")[1] for v in (3, 4) for p in buckets.listed(spark, folder, v).values()}
    there = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t/data").glob("v*/bucket=*")}
    assert there == kept


def test_what_runs_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    put = buckets.upsert_sink(folder, ["k"])
    put(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], SHAPE), 0)
    put(spark.createDataFrame([(2, "c", 0), (3, "d", 0)], SHAPE), 1)
    put(spark.createDataFrame([(2, "zzz", 0)], SHAPE), 1)
    assert rows_of(buckets.read(spark, folder)) == [(1, "a", 0), (2, "c", 0), (3, "d", 0)]
    with pytest.raises(FileNotFoundError):
        put(spark.createDataFrame([(9, "y", 1)], SHAPE), 7)
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, str(tmp_path / "none"))


def test_crash_before_the_version_is_listed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    buckets.merge(spark.createDataFrame([(1, "a", 0)], SHAPE), folder, 0, ["k"])

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_publish", crash)
        with pytest.raises(OSError, match="lost"):
            buckets.merge(spark.createDataFrame([(1, "b", 0), (2, "b", 0)], SHAPE), folder, 1, ["k"])
    assert buckets.latest(spark, folder) == 0 and rows_of(buckets.read(spark, folder)) == [(1, "a", 0)]
    buckets.merge(spark.createDataFrame([(1, "c", 0)], SHAPE), folder, 1, ["k"])
    assert rows_of(buckets.read(spark, folder)) == [(1, "c", 0)]


def test_stream_of_files(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, f"b{i}", i) for k in range(i, i + 3)], SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = Q.merged_into(stream, str(tmp_path / "out"), ["k"], ["at"])
    assert rows_of(got) == [(0, "b0", 0), (1, "b1", 1), (2, "b2", 2), (3, "b2", 2), (4, "b2", 2)]
    assert got.where(F.col("k").isNull()).isEmpty()
