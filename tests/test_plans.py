"""Queries on tables that differ from the driver's smallest: what only larger or odd ones show."""

from pyspark.sql import functions as F

from tallyforge import plans


def parts(spark, folder, n, key="id"):
    """A table of n parts whose keys are the numbers of expression key; the folder."""
    part = spark.range(1, n + 1).select(
        F.expr(key).cast("long").alias("p_partkey"), F.concat(F.lit("blue part "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("PROMO").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"),
        F.lit(1.5).alias("p_retailprice"))
    part.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_timers_of_long_quizzes(spark, tmp_path):
    """Positions beyond the greatest time that can be added."""
    got = plans.queries()["question_timers"](spark, parts(spark, tmp_path, 3700, "id * 5"))
    told = {r["id"]: r["timer"] for r in got.collect()}
    plain = {5 * i: 30 if 5 * i % 11 == 0 or 5 * i % 13 == 0 else i for i in range(1, 3701)}
    assert told == plain


def test_readings_put_torn_words_together(spark, tmp_path):
    got = plans.queries()["readings"](spark, parts(spark, tmp_path, 12)).collect()
    assert {r["p_partkey"]: r["joined"] for r in got} == {i: f"राजस्थान blue part {i}" for i in range(1, 13)}
    assert {r["p_partkey"]: r["text"] for r in got} == {i: f"Answer: {'B?A'[i % 3]}" for i in range(1, 13)}


def test_typed_questions_are_dealt(spark, tmp_path):
    """Many parts lie in one small file; to parse them is work for every task."""
    folder = parts(spark, tmp_path, 100)
    spark.read.parquet(f"{folder}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/one/part.parquet")
    for name in ("typed_questions", "forwarded_questions"):
        found = plans.queries()[name](spark, f"{tmp_path}/one")
        assert found.rdd.getNumPartitions() == 4 and found.count() == 100
