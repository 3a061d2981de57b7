"""From documents to training tokens: each stage reads what the one before kept. Part of the training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, langid, mixing, quality, spm
from tallyforge.llm.common import n_words, stage, table

#: Near copies: texts whose sets of SHINGLE-word shingles have a Jaccard similarity of NUM / DEN or more.
SHINGLE, NUM, DEN = 5, 80, 100


def _hidden(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of a stage's own that no column of docs has, in any case of letters."""
    taken, lead = {c.lower() for c in docs.columns}, "_tf_"
    while any(c.startswith(lead) for c in taken):
        lead = "_" + lead
    return [lead + n for n in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence.

    Null texts and texts without a letter go, since no language can be told of them; very long texts are read whole;
    repeated rows and ties go or stay together; without labelled rows nothing is told and all go; an empty table gives
    no rows; other columns pass through, whatever their names.
    """
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts count as empty and are scored; very long texts are read whole; repeated rows and ties go or stay
    together; without labels every score is 0.5 and all go; an empty table gives no rows; other columns pass through.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, then of the least hash of the text.

    A group without any id keeps one row too. Null texts, and texts without a word, have no near copies and stay, and so do
    rows of equal id whose texts are no near copies. Of equal ids and texts the row of the least other columns stays.
    Very long texts are compared whole; an empty table gives no rows; other columns pass through, whatever their names.
    """
    key, digest, many = _hidden(docs, "id", "hash", "many")
    rows = stage(jaccard.grouped(docs, SHINGLE, NUM, DEN), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    least = rows.where("label IS NOT NULL").groupBy("label").agg(first.alias("least")).select("label", "least.doc_id", "least.text_hash")
    same = rows.where("label IS NOT NULL").groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"label": "l", "doc_id": "d", "text_hash": "h"})
    chosen = least.join(same, (F.col("label") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    chosen = chosen.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), (F.col("c") > 1).alias(many))
    wordless = n_words(F.col("text")) == 0
    picked = docs.where(~wordless).withColumn(digest, F.xxhash64("text")).join(chosen.withColumnRenamed(digest, digest + "2"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(digest + "2")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = picked.where(F.col(many)).groupBy(key, digest).agg(F.min(F.struct(*columns)).alias(many)).select(f"{many}.*")
    return picked.where(~F.col(many)).select(*columns).unionByName(again).unionByName(docs.where(wordless))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; a null source is a source; very long texts count whole; of
    rows with one id each counts by its own source and text, which a 64-bit hash tells apart; rows equal in id, source
    and text are taken alike, each as often as the mix takes them on average, rounded; equal keys go by id; an empty
    table gives no rows; other columns pass through, whatever their names.
    """
    key, source, digest, times, turn = _hidden(docs, "id", "source", "hash", "times", "turn")
    taken = mixing.mix(docs, also=(F.col("source"), F.xxhash64("text"))).where("size > 0")
    taken = taken.groupBy(F.col("doc_id").alias(key), F.col("_also0").alias(source), F.col("_also1").alias(digest)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(times)).where(F.col(times) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(digest + "2") == F.col(digest))
    rows = docs.where(F.col("text").isNotNull()).withColumn(digest + "2", F.xxhash64("text")).join(taken, same)
    return rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document.

    A null text has null ids and an empty one none; very long texts are encoded whole; repeated rows give repeated
    rows; an empty table gives no rows; other columns are left out.
    """
    return spm.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", one_of_each), ("mixing sources", mixed), ("SentencePiece encoding", tokens),
]
#: Trained models and tokens are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
