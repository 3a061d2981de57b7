"""Attempt statistics, leaderboards, ranks and histories.

Every operator answers for all quizzes or users at once; filter its input for one. Per-group top-k is a window with a
row number under a limit, which Spark turns into a group limit before the shuffle, so a hot quiz sends k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .ranking import numbered

DONE = ("finished", "stopped")


def done(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("status").isin(*DONE))


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1) if condition is None else F.when(condition, 1))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def quiz_stats(attempts: DataFrame) -> DataFrame:
    pct = F.when(F.col("total") > 0, F.lit(100.0) * F.col("correct") / F.col("total"))
    return done(attempts).groupBy("quiz_id").agg(
        _count().alias("attempts"), F.countDistinct("user_id").alias("users"), *map(_total, ("correct", "wrong", "skipped", "timeouts")),
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total_questions"), F.round(F.coalesce(F.avg(pct), F.lit(0.0)), 6).alias("avg_pct"),
    )


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Each user's best attempt at each quiz: net score, then time, then id. An aggregate, so it combines before the shuffle."""
    net = S.raw_net(F.col("correct"), F.col("wrong"), F.col("negative_mark"))
    rows = attempts.withColumn("net", net)
    best = F.min_by(F.struct(*rows.columns), F.struct(-F.col("net"), F.coalesce(F.col("duration_sec"), F.lit(float("-inf"))), F.col("id")))
    return rows.groupBy("quiz_id", "user_id").agg(best.alias("best")).select("best.*")


def leaders(attempts: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """The k best users of each quiz, by their best finished or stopped attempt; equal ones by attempt id."""
    order = Window.partitionBy("quiz_id").orderBy(F.desc("net"), "duration_sec", "id")
    top = best_attempts(done(attempts)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.join(users, "user_id", "left").select("quiz_id", "place", "user_id", "username", "first_name", "correct", "wrong", "skipped", "total", "duration_sec", "status", F.coalesce("negative_mark", F.lit(0.0)).alias("negative_mark"), "net")


def ranks(attempts: DataFrame) -> DataFrame:
    """Rank and number of participants, by best finished attempts only (stopped ones don't count)."""
    best = best_attempts(attempts.where(F.col("status") == "finished"))
    placed = numbered(best, ["quiz_id"], [F.desc("net"), F.asc("duration_sec"), F.asc("id")], "rank", "participants")
    return placed.select("quiz_id", "user_id", F.col("rank").cast("int").alias("rank"), "participants")


def user_totals(attempts: DataFrame) -> DataFrame:
    return done(attempts).groupBy("user_id").agg(_count().alias("attempts"), *map(_total, ("correct", "wrong", "skipped", "timeouts", "total")))


def _last(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= k)


def user_history(attempts: DataFrame, quizzes: DataFrame, k: int = 15) -> DataFrame:
    """Each user's last k attempts, latest first; the title is null when the quiz is gone."""
    last = _last(done(attempts), "user_id", k, F.desc("id"))
    return last.join(quizzes.select(F.col("id").alias("quiz_id"), "title"), "quiz_id", "left").select("user_id", "n", "id", "quiz_id", "title", "status", "correct", "wrong", "total")


def recent_played(attempts: DataFrame, quizzes: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """The k quizzes of others that each user played last."""
    last = attempts.groupBy("user_id", "quiz_id").agg(F.max("id").alias("last_attempt"))
    theirs = last.join(quizzes.select(F.col("id").alias("quiz_id"), "title", "owner_id"), "quiz_id").where(F.col("owner_id") != F.col("user_id"))
    top = _last(theirs, "user_id", k, F.desc("last_attempt"))
    return top.join(question_counts(questions), "quiz_id", "left").select("user_id", "n", "quiz_id", "title", "owner_id", "last_attempt", F.coalesce("question_count", F.lit(0)).alias("question_count"))


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("quiz_id").agg(_count().alias("question_count"), F.min("source_number").alias("first_number"), F.max("source_number").alias("last_number"))


def latest_completed(attempts: DataFrame) -> DataFrame:
    return done(attempts).groupBy("user_id").agg(F.max_by(F.struct("id", "quiz_id", "status"), "id").alias("a")).select("user_id", "a.*")


def answered(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Done attempts with a counted answer, or with any recorded choice. Two conditions joined by OR, so the choices come in as a flag."""
    chose = answers.where(F.col("chosen_index").isNotNull()).select(F.col("attempt_id").alias("id")).distinct().withColumn("chose", F.lit(True))
    return done(attempts).join(chose, "id", "left").where((F.col("correct") + F.col("wrong") > 0) | F.coalesce("chose", F.lit(False))).drop("chose")


def latest_answered(attempts: DataFrame, answers: DataFrame, *by: str) -> DataFrame:
    """The latest answered attempt of each user, or of each of `by`."""
    keys = list(by) or ["user_id"]
    found = answered(attempts, answers).groupBy(*keys).agg(F.max_by(F.struct("id", "status", "correct", "wrong"), "id").alias("a"))
    return found.select(*keys, "a.*")


def active_attempts(attempts: DataFrame) -> DataFrame:
    """The running attempt of each user: the latest one."""
    return attempts.where(F.col("status") == "active").groupBy("user_id").agg(F.max("id").alias("id"), _count().alias("running"))


def _session_sums(group_answers: DataFrame) -> DataFrame:
    return group_answers.groupBy("session_id", "user_id").agg(
        F.sum("is_correct").alias("correct"), F.sum(1 - F.col("is_correct")).alias("wrong"), _count().alias("answered"), F.coalesce(F.sum(F.col("elapsed").cast("decimal(20,6)")), F.lit(0)).cast("double").alias("elapsed"))


def group_leaderboard(group_answers: DataFrame, users: DataFrame) -> DataFrame:
    """Totals of each participant in each session, best first. Sums come before the join with users."""
    sums = _session_sums(group_answers)
    placed = numbered(sums, ["session_id"], [F.desc("correct"), F.asc("elapsed"), F.asc("user_id")])
    return placed.withColumn("place", F.col("place").cast("int")).join(users.select("user_id", "username", "first_name"), "user_id", "left")


def group_results(sessions: DataFrame, group_answers: DataFrame, users: DataFrame) -> DataFrame:
    """The final table of each session: by net score where marks are lost, else by correct answers; then time and id."""
    board = _session_sums(group_answers).join(users.select("user_id", "username", "first_name"), "user_id", "left")
    rows = board.join(sessions.select(F.col("id").alias("session_id"), "status", "asked", "total", "negative_mark"), "session_id")
    asked = F.when(F.col("status") == "stopped", F.coalesce("asked", F.lit(0))).otherwise(F.col("total"))
    neg = S.negative_of(F.col("negative_mark"))
    rows = rows.withColumn("denom", F.when(asked > 0, asked).otherwise(F.col("total"))).withColumn("net", S.net_score(F.col("correct"), F.col("wrong"), F.col("negative_mark")))
    first = F.when(neg > 0, F.col("net")).otherwise(F.col("correct").cast("double"))
    rows = numbered(rows.withColumn("_first", first), ["session_id"], [F.desc("_first"), F.desc("correct"), F.asc("elapsed"), F.asc("user_id")])
    return rows.select(
        "session_id", F.col("place").cast("int").alias("place"), "user_id", S.group_name(F.col("username"), F.col("first_name"), F.col("user_id")).alias("name"), "correct", "wrong",
        S.unanswered(F.col("denom"), F.col("answered")).alias("skipped"), "denom", F.when(neg > 0, F.col("net")).alias("net"), S.percentage(F.col("correct"), F.col("denom")).alias("pct"))


def group_quiz_stats(sessions: DataFrame, group_answers: DataFrame) -> DataFrame:
    """Sessions, chats and participants of each quiz's finished or stopped sessions."""
    s = sessions.where(F.col("status").isin(*DONE)).select(F.col("id").alias("session_id"), "quiz_id", "chat_id")
    took = group_answers.select("session_id", "user_id").distinct()
    return s.join(took, "session_id", "left").groupBy("quiz_id").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("chat_id").alias("groups"), F.countDistinct("user_id").alias("participants"))


def user_group_history(sessions: DataFrame, group_answers: DataFrame, quizzes: DataFrame, k: int = 10) -> DataFrame:
    """The last k done sessions that each user answered in or started; answered ones first."""
    took = group_answers.groupBy(F.col("session_id").alias("id"), "user_id").agg(_count().alias("user_answered"))
    began = sessions.select("id", F.col("started_by").alias("user_id"), F.lit(0).cast("long").alias("user_answered"))
    every = took.unionByName(began).groupBy("id", "user_id").agg(F.max("user_answered").alias("user_answered"))
    rows = every.join(sessions.where(F.col("status").isin(*DONE)), "id").join(quizzes.select(F.col("id").alias("quiz_id"), F.col("title").alias("quiz_title")), "quiz_id", "left")
    return _last(rows, "user_id", k, (F.col("user_answered") > 0).desc(), F.desc("id")).select("user_id", "n", "id", "quiz_title", "status", "user_answered")


def latest_group_session(sessions: DataFrame, group_answers: DataFrame) -> DataFrame:
    """For each user and quiz: the latest session that the user answered in, done ones first."""
    took = group_answers.select(F.col("session_id").alias("id"), "user_id").distinct()
    rows = took.join(sessions, "id")
    key = F.struct(F.col("status").isin(*DONE), F.col("id"))
    return rows.groupBy("user_id", "quiz_id").agg(F.max_by(F.struct("id", "status"), key).alias("s")).select("user_id", "quiz_id", "s.*")


def quizzes_with_settings(quizzes: DataFrame, settings: DataFrame, questions: DataFrame) -> DataFrame:
    joined = quizzes.join(settings.withColumnRenamed("quiz_id", "id"), "id", "left").join(question_counts(questions).withColumnRenamed("quiz_id", "id"), "id", "left")
    fill = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return joined.select("id", "title", "owner_id", "status", fill("timer", 30), fill("shuffle_questions", 0), fill("shuffle_options", 0), fill("question_count", 0))


def series_parts(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    counted = quizzes.where(F.col("series_id").isNotNull()).join(question_counts(questions).withColumnRenamed("quiz_id", "id"), "id", "left")
    return counted.select("series_id", "part_no", "id", "status", F.coalesce("question_count", F.lit(0)).alias("question_count"), "first_number", "last_number")


def next_parts(quizzes: DataFrame) -> DataFrame:
    """The next ready part of each quiz in a series; null after the last, and for a quiz without a part number."""
    parts = quizzes.where(F.col("series_id").isNotNull())
    later = Window.partitionBy("series_id").orderBy("part_no").rangeBetween(1, Window.unboundedFollowing)
    ready = F.when((F.col("status") == "ready") & F.col("part_no").isNotNull(), F.struct("part_no", "id"))
    return parts.select("id", F.when(F.col("part_no").isNotNull(), F.min(ready).over(later)["id"]).alias("next_id"))


def owner_quizzes(quizzes: DataFrame, questions: DataFrame, drafts: bool = True) -> DataFrame:
    shown = quizzes.where(F.col("status") != "archived")  # a null status is hidden too
    shown = shown if drafts else shown.where(F.col("status") == "ready")
    return shown.join(question_counts(questions).withColumnRenamed("quiz_id", "id"), "id", "left").select("owner_id", "id", "title", "status", F.coalesce("question_count", F.lit(0)).alias("question_count"))


def batch_sizes(batches: DataFrame, members: DataFrame) -> DataFrame:
    sizes = members.groupBy(F.col("batch_name").alias("name")).agg(_count().alias("members"))
    return batches.join(sizes, "name", "left").select("name", F.coalesce("members", F.lit(0)).alias("members"))


def results(attempts: DataFrame) -> DataFrame:
    """What an attempt's result shows: unanswered, percentage, timeouts within skipped, net score."""
    c = F.col
    return attempts.select(
        "id", "correct", "wrong", "skipped", S.unanswered(c("total"), c("correct"), c("wrong"), c("skipped")).alias("unanswered"), S.percentage(c("correct"), c("total")).alias("percentage"),
        F.least("timeouts", "skipped").alias("timeouts"), S.net_score(c("correct"), c("wrong"), c("negative_mark")).alias("net"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row for each table: its name and number of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(_count().alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
