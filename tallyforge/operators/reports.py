"""Answer reports: each question of an attempt with the answer that counts for it, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .stats import answered

CORRECT, WRONG, UNANSWERED = "correct", "wrong", "unanswered"


def index_answers(answers: DataFrame, *key: str) -> DataFrame:
    """The answer that counts for each key: the latest with a choice, else the first without. One aggregate."""
    chose = F.col("chosen_index").isNotNull()
    rank = F.struct(chose.alias("c"), F.when(chose, F.col("id")).otherwise(-F.col("id")).alias("i"))
    kept = [c for c in answers.columns if c not in key]
    return answers.groupBy(*key).agg(F.max_by(F.struct(*kept), rank).alias("a"))


def matched(papers: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """papers with the answer `a` to each question: by question id, else by place. `by` is the column that both sides share (attempt or session and user)."""
    keys = by.split(",")
    of_question = index_answers(answers.where(F.coalesce("question_id", F.lit(0)) != 0), *keys, "question_id").withColumnRenamed("a", "q")
    of_place = index_answers(answers.where(F.col("position").isNotNull()).withColumnRenamed("position", "idx"), *keys, "idx").withColumnRenamed("a", "p")
    common = ("chosen_index", "correct", "status")
    pick = F.when(F.col("q").isNotNull(), F.struct(*[F.col(f"q.{c}").alias(c) for c in common])).when(F.col("p").isNotNull(), F.struct(*[F.col(f"p.{c}").alias(c) for c in common]))
    return papers.join(of_question, [*keys, "question_id"], "left").join(of_place, [*keys, "idx"], "left").withColumn("a", pick).drop("q", "p")


def attempt_report(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """attempt_id, idx, question_id, chosen, status, skipped. With a known right option the choice decides, whatever flag was stored."""
    rows = matched(papers, answers, "attempt_id")
    passed = F.lower("a.status").isin("skipped", "timeout")
    blank = F.col("a").isNull() | passed | F.col("a.chosen_index").isNull()
    hit = F.when(F.col("correct_index").isNotNull(), F.col("a.chosen_index") == F.col("correct_index")).otherwise(F.coalesce("a.correct", F.lit(0)) == 1)
    status = F.when(F.coalesce(blank, F.lit(True)), UNANSWERED).when(hit, CORRECT).otherwise(WRONG)
    return rows.select("attempt_id", "idx", "question_id", F.when(status != UNANSWERED, F.col("a.chosen_index")).alias("chosen"), status.alias("status"), F.coalesce(passed, F.lit(False)).alias("skipped"))


def group_report(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """session_id, user_id, idx, question_id, chosen, status. Here a stored right flag counts even against the known option."""
    rows = matched(papers, answers, "session_id,user_id")
    hit = (F.coalesce("a.correct", F.lit(0)) == 1) | F.coalesce(F.col("a.chosen_index") == F.col("correct_index"), F.lit(False))
    status = F.when(F.col("a").isNull() | F.col("a.chosen_index").isNull(), UNANSWERED).when(hit, CORRECT).otherwise(WRONG)
    return rows.select("session_id", "user_id", "idx", "question_id", F.when(status != UNANSWERED, F.col("a.chosen_index")).alias("chosen"), status.alias("status"))


def report_totals(report: DataFrame, marks: DataFrame, *by: str) -> DataFrame:
    """Totals of each report, its net score where marks (by, negative_mark) lose any, and whether the parts add up."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = report.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n(CORRECT).alias("correct"), n(WRONG).alias("incorrect"), n(UNANSWERED).alias("unanswered")).join(marks, list(by), "left")
    neg = S.negative_of(F.col("negative_mark"))
    return out.select(
        *by, "total", "correct", "incorrect", "unanswered", S.percentage(F.col("correct"), F.col("total")).alias("percentage"), F.when(neg > 0, S.round2(F.col("incorrect") * neg)).alias("penalty"),
        F.when(neg > 0, S.net_score(F.col("correct"), F.col("incorrect"), neg)).alias("net"), (F.col("correct") + F.col("incorrect") + F.col("unanswered") == F.col("total")).alias("consistent"))


def report_targets(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """attempt_id, used_id: an attempt without answers is reported by the latest answered one of the same user and quiz."""
    some = answers.select(F.col("attempt_id").alias("id")).distinct()
    empty = attempts.join(some, "id", "left_anti").select("id", "user_id", "quiz_id")
    latest = answered(attempts, answers).groupBy("user_id", "quiz_id").agg(F.max("id").alias("used_id"))
    other = empty.join(latest, ["user_id", "quiz_id"], "left").select(F.col("id").alias("attempt_id"), F.coalesce("used_id", "id").alias("used_id"))
    return attempts.join(some, "id", "left_semi").select(F.col("id").alias("attempt_id"), F.col("id").alias("used_id")).unionByName(other)


def section_breakdown(papers: DataFrame, answers: DataFrame, marks: DataFrame) -> DataFrame:
    """Scores of each section of each attempt whose paper names one; blank sections are General. The last answer to a question counts."""
    last = answers.where(F.col("question_id").isNotNull()).groupBy("attempt_id", "question_id").agg(F.max_by(F.struct("status", "correct"), "id").alias("a"))
    named = F.max(F.coalesce(F.trim("section"), F.lit("")) != "").over(Window.partitionBy("attempt_id"))
    rows = papers.withColumn("named", named).where("named").join(last, ["attempt_id", "question_id"], "left")
    section = F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("General"))
    hit = F.coalesce((F.col("a.status") == "correct") | (F.col("a.correct") == 1), F.lit(False))
    miss = ~hit & F.coalesce(F.col("a.status") == "wrong", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("attempt_id", section.alias("section")).agg(F.count(F.lit(1)).alias("total"), n(hit).alias("correct"), n(miss).alias("wrong"), n(~hit & ~miss).alias("skipped")).join(marks, "attempt_id", "left")
    return out.select("attempt_id", "section", "total", "correct", "wrong", "skipped", S.net_score(F.col("correct"), F.col("wrong"), F.col("negative_mark")).alias("score"))


def number_of(source_number: Column, position: Column) -> Column:
    """The number a question shows: that of its source, else its place."""
    return F.when(source_number > 0, source_number).otherwise(F.coalesce(position, F.lit(0)))
