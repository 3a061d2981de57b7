"""Event rules in batch form: first answer wins, late answers, streaks, pauses, quotas, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUTO_PAUSE = 5
DAY_S = 86_400


def micros(c: F.Column | str) -> F.Column:
    """A timestamp, with or without zone, as microseconds."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key, the first by order. An aggregate, so a hot key combines before the shuffle."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("r")).select(*keys, "r.*")


def in_time(answers: DataFrame, polls: DataFrame) -> DataFrame:
    """Answers given while their poll was open (polls: session_id, question_id, sent_at, closed_at or null); later ones never count."""
    rows = answers.join(polls, ["session_id", "question_id"])
    return rows.where((F.col("answered_ts") >= F.col("sent_at")) & (F.col("closed_at").isNull() | (F.col("answered_ts") < F.col("closed_at")))).select(*answers.columns)


def miss_streaks(answers: DataFrame, by: str, *order: str) -> DataFrame:
    """by, streak, start, end of each run of unanswered questions (gaps and islands); start and end are places in the order."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = answers.select(by, F.row_number().over(w).alias("n"), (~F.col("status").isin("correct", "wrong")).alias("miss"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(by, "miss").orderBy("n"))
    runs = rows.withColumn("island", island).where("miss").groupBy(by, "island")
    return runs.agg(F.count(F.lit(1)).alias("streak"), F.min("n").alias("start"), F.max("n").alias("end")).drop("island")


def auto_pauses(answers: DataFrame, by: str, *order: str, misses: int = AUTO_PAUSE) -> DataFrame:
    """by, pauses: how often a run of misses reaches the limit; the count starts anew after each pause."""
    return miss_streaks(answers, by, *order).groupBy(by).agg(F.sum(F.floor(F.col("streak") / misses)).cast("long").alias("pauses")).where("pauses > 0")


def pauses(controls: DataFrame, by: str) -> DataFrame:
    """by, pauses, paused_s of control events (by, ts, id, kind pause or resume).

    A pause while paused, or a resume while running, changes nothing, so only events that differ from the one before count.
    """
    w = Window.partitionBy(by).orderBy("ts", "id")
    told = controls.where(F.col("kind").isin("pause", "resume")).withColumn("was", F.lag("kind", 1, "resume").over(w)).where(F.col("kind") != F.col("was"))
    w = Window.partitionBy(by).orderBy("ts", "id")
    spans = told.withColumn("until", F.lead("ts").over(w)).where(F.col("kind") == "pause")
    span = F.greatest(F.lit(0), micros("until") - micros("ts"))
    return spans.groupBy(by).agg(F.count("until").alias("pauses"), F.coalesce(F.sum(span), F.lit(0)).cast("long").alias("paused_us"))


def quota(events: DataFrame, by: str = "user_id", window_s: int = DAY_S) -> DataFrame:
    """Each event with the number of its user's events in the window up to it, and microseconds since the one before."""
    us = micros("ts")
    rolling = Window.partitionBy(by).orderBy(us).rangeBetween(-window_s * 1_000_000, 0)
    return events.select("event_id", by, F.count(F.lit(1)).over(rolling).alias("in_window"), (us - F.lag(us).over(Window.partitionBy(by).orderBy(us, "event_id"))).alias("since_us"))


def number_gaps(numbers: DataFrame, by: str) -> DataFrame:
    """by, missing: each number that a strictly rising sequence (by, pos, number) leaves out."""
    w = Window.partitionBy(by).orderBy("pos")
    after = F.lead("number").over(w)
    rows = numbers.select(by, "number", after.alias("after")).where(F.col("after") > F.col("number") + 1)
    return rows.select(by, F.explode(F.sequence(F.col("number") + 1, F.col("after") - 1)).alias("missing"))


def headings(lines: DataFrame, by: str, is_heading: F.Column) -> DataFrame:
    """lines (by, pos, text) with the nearest heading at or before each: an as-of join as one window."""
    w = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(w))


def terminal(events: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """The one event that ends each session: the first of kinds; later ones find it ended."""
    return first_wins(events.where(F.col("kind").isin(kinds)), [by], "ts", "id")


def expired(sessions: DataFrame, now: F.Column, hours: int = 24) -> DataFrame:
    """Running sessions older than the limit, pauses not counted."""
    age = micros(now) - micros("started_at") - F.coalesce("paused_us", F.lit(0))
    return sessions.where((F.col("status") == "active") & (age > hours * 3_600_000_000))


def answered_elapsed(sent_us: F.Column, now_us: F.Column, pause_us: F.Column) -> F.Column:
    """Time that an answer took: since its poll went out, never below 0, and what was spent before a pause."""
    return F.greatest(F.lit(0), now_us - sent_us) + F.coalesce(pause_us, F.lit(0))


def active_duration(started_us: F.Column, ended_us: F.Column, paused_us: F.Column, pause_began_us: F.Column) -> F.Column:
    """How long an attempt ran: from start to end without its pauses, the running one included."""
    running = F.coalesce(F.greatest(F.lit(0), ended_us - pause_began_us), F.lit(0))
    return F.greatest(F.lit(0), ended_us - started_us - F.coalesce(paused_us, F.lit(0)) - running)
