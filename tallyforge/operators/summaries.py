"""What users read of attempts and quizzes: results, overviews and statistics, a text for each row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import stats

# Medals, and how many lines a list has.
MEDALS = ("🥇", "🥈", "🥉")
OVERVIEW, OWN, OWN_OF_OWNER, TOP, TITLE = 10, 10, 5, 10, 35


def escaped(text: Column) -> Column:
    """Text inside HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _lines(*parts: Column) -> Column:
    """Those of some lines that aren't null, one below the other."""
    return F.array_join(F.filter(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))), lambda x: x.isNotNull()), "\n")


def _one(*lines: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def _with_net(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("net", S.net_score(F.col("correct"), F.col("wrong"), F.col("negative_mark")))


def result_texts(attempts: DataFrame, quizzes: DataFrame) -> DataFrame:
    """id, text: the result of each finished or stopped attempt, with its rank if it is finished and others took part."""
    c = F.col
    rows = _with_net(stats.done(attempts)).join(quizzes.select(c("id").alias("quiz_id"), "title"), "quiz_id", "left").join(stats.ranks(attempts), ["quiz_id", "user_id"], "left")
    stopped, open_ = c("status") == "stopped", S.unanswered(c("total"), c("correct"), c("wrong"), c("skipped"))
    marked = S.negative_of(c("negative_mark")) > 0
    lost = S.format_score(c("wrong") * S.negative_of(c("negative_mark")))
    text = _lines(
        _one(F.when(stopped, "⏹ <b>Quiz stopped</b> — partial result saved").otherwise("🏁 <b>The quiz has finished!</b>"), "", "📊 <b>Result</b>", _said("Quiz: ", escaped(F.coalesce("title", F.lit("")))), _said("Total: ", c("total")),
             _said("Correct: ", c("correct"), " ✅"), _said("Wrong: ", c("wrong"), " ❌"), _said("Skipped: ", c("skipped"), " ⌛"), _said("Timeout: ", c("timeouts"), " ⏰", F.when(c("timeouts") > 0, " (Skipped में शामिल)").otherwise(""))),
        F.when(open_ > 0, _one(_said("Not attempted: ", open_))),
        _one(_said("Score: ", c("correct"), "/", c("total")), _said("Percentage: ", F.format_string("%.2f%%", S.percentage(c("correct"), c("total")))), _said("Time: ", S.format_duration(c("duration_sec")))),
        F.when(marked, _one(_said("Negative Marking: -", S.negative_label(c("negative_mark")), " प्रति गलत उत्तर (−", lost, ")"), _said("Net Score: <b>", S.score_text(c("net")), "/", c("total"), "</b>"))),
        F.when(~stopped & (c("participants") > 1), _one("", _said("🏆 आपकी rank (best attempt): ", c("rank"), " / ", c("participants"), " participants"))),
    )
    return rows.select("id", text.alias("text"))


def _listed(rows: DataFrame, by: list[str], order: list[Column], line: Column, k: int, name: str) -> DataFrame:
    """by and the first k lines of each group in order. Spark keeps k rows of a group before it shuffles."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias(name)).withColumn(name, F.transform(name, lambda x: x["line"]))


def _history() -> Column:
    return S.history_line(*map(F.col, ("correct", "wrong", "skipped", "timeouts", "total", "net", "negative_mark", "duration_sec", "finished_at", "status")))


def user_overviews(attempts: DataFrame, quizzes: DataFrame, k: int = OVERVIEW) -> DataFrame:
    """user_id, text: all attempts of each user in numbers, and the last k."""
    c = F.col
    rows = _with_net(stats.done(attempts)).join(quizzes.select(c("id").alias("quiz_id"), "title"), "quiz_id", "left")
    title = escaped(F.substr(F.coalesce(F.when(c("title") != "", c("title")), F.lit("Deleted quiz")), F.lit(1), F.lit(TITLE)))
    line = _said("• ", title, ": ", c("correct"), "/", c("total"), " (", S.percent(c("correct"), c("total")), ")", S.net_suffix(c("net"), c("negative_mark")), " • ", F.coalesce(F.date_format("finished_at", "yyyy-MM-dd"), F.lit("")), F.when(c("status") == "stopped", " ⏹").otherwise(""))
    last = _listed(rows, ["user_id"], [F.desc("id")], line, k, "last")
    both = stats.user_totals(attempts).join(last, "user_id")
    text = _lines(
        _one("📊 <b>Quiz Stats</b>", "", _said("🎮 आपके attempts: ", c("attempts")), _said("✅ Correct: ", c("correct"), "   ❌ Wrong: ", c("wrong"), "   ⏭ Skipped: ", c("skipped"), "   ⏰ Timeout: ", c("timeouts")), _said("📈 Overall: ", S.percent(c("correct"), c("total"))), "", "📜 <b>Result history</b>"),
        c("last"))
    return both.select("user_id", text.alias("text"))


def owner_texts(quizzes: DataFrame, attempts: DataFrame, users: DataFrame, sessions: DataFrame, group_answers: DataFrame) -> DataFrame:
    """quiz_id, text: what an owner sees of each quiz: sums, group sessions, the best users, and the owner's own last results."""
    c = F.col
    best = stats.leaders(attempts, users, TOP).withColumn("net", S.net_score(c("correct"), c("wrong"), c("negative_mark")))
    place = F.coalesce(F.get(F.array(*map(F.lit, MEDALS)), c("place") - 1), _said(c("place"), "."))
    line = _said(place, " ", escaped(S.stats_name(c("username"), c("first_name"), c("user_id"))), " — ", c("correct"), "/", c("total"), " (", S.percent(c("correct"), c("total")), ")", S.net_suffix(c("net"), c("negative_mark")), " • ", S.format_duration(c("duration_sec")))
    leaders = best.groupBy("quiz_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("leaders")).withColumn("leaders", F.transform("leaders", lambda x: x["line"]))
    owners = quizzes.select(c("id").alias("quiz_id"), c("owner_id").alias("user_id"), "title")
    own = _listed(_with_net(stats.done(attempts)).join(owners.select("quiz_id", "user_id"), ["quiz_id", "user_id"]), ["quiz_id"], [F.desc("id")], _history(), OWN_OF_OWNER, "own")
    groups = stats.group_quiz_stats(sessions, group_answers)
    rows = owners.join(stats.quiz_stats(attempts), "quiz_id", "left").join(groups, "quiz_id", "left").join(leaders, "quiz_id", "left").join(own, "quiz_id", "left")
    n = lambda name: F.coalesce(c(name), F.lit(0))
    shown = F.format_string("%.1f", S.round_to(F.coalesce("avg_pct", F.lit(0.0)), 1))
    text = _lines(
        _one(_said("📊 <b>", escaped(c("title")), "</b>"), "", _said("👥 Total attempts: ", n("attempts"), " (", n("users"), " users)"), _said("✅ Correct answers: ", n("correct")), _said("❌ Wrong answers: ", n("wrong")),
             _said("⏭ Skipped: ", n("skipped"), " (⏰ Timeout: ", n("timeouts"), ")"), _said("📈 Average score: ", shown, "%")),
        F.when(n("sessions") > 0, _one("", _said("👥 Group quizzes: ", c("sessions"), " sessions in ", c("groups"), F.when(c("groups") == 1, " group").otherwise(" groups"), " · ", c("participants"), " participants"))),
        F.when(c("leaders").isNotNull(), _one("", "🏆 <b>Top users</b>")), c("leaders"), F.when(c("own").isNotNull(), _one("", "📜 <b>आपके पिछले results</b>")), c("own"),
    )
    return rows.select("quiz_id", text.alias("text"))


def own_texts(quizzes: DataFrame, attempts: DataFrame, viewers: DataFrame, k: int = OWN) -> DataFrame:
    """quiz_id, user_id, text: what each viewer (quiz_id, user_id) who is no owner sees of a quiz: the own rank and results, and nothing of others."""
    c = F.col
    asked = viewers.select("quiz_id", "user_id").distinct().join(quizzes.select(c("id").alias("quiz_id"), "title", "owner_id"), "quiz_id").where(~c("owner_id").eqNullSafe(c("user_id")))
    last = _listed(_with_net(stats.done(attempts)), ["quiz_id", "user_id"], [F.desc("id")], _history(), k, "own")
    rows = asked.join(stats.ranks(attempts), ["quiz_id", "user_id"], "left").join(last, ["quiz_id", "user_id"], "left")
    text = _lines(
        _one(_said("📊 <b>", escaped(c("title")), "</b>")), F.when(c("rank").isNotNull(), _one("", _said("🏆 आपकी rank (best attempt): ", c("rank"), " / ", c("participants")))),
        F.when(c("own").isNull(), _one("", "ℹ️ आपने अभी यह quiz पूरा नहीं किया है।")).otherwise(_one("", "📜 <b>आपके results</b>")), c("own"),
    )
    return rows.select("quiz_id", "user_id", text.alias("text"))


def status_text(counts: DataFrame, violations: DataFrame, most: int = 3) -> DataFrame:
    """text: one row that tells how many records a snapshot has (counts: name, rows) and what is wrong with it (violations: rule, record), the most frequent rules first."""
    c = F.col
    held = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "rows"))), lambda x: _said(x["name"], "=", x["rows"])), ", ").alias("held"))  # a row for each table
    broken = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    told = broken.agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("less"), "rule"))).alias("all"))  # a row for each rule
    named = F.array_join(F.transform(F.slice("all", 1, most), lambda x: _said(x["rule"], ": ", -x["less"])), "; ")
    integrity = F.when(F.size("all") == 0, F.lit("✅ valid")).otherwise(_said("❌ ", named))
    both = held.withColumn("_one", F.lit(1)).join(told.withColumn("_one", F.lit(1)), "_one")
    return both.select(_lines(_one("🗄️ <b>Backup status</b>", _said("Records: ", c("held")), _said("Integrity: ", integrity))).alias("text"))
