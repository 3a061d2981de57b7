"""Statistics, leaderboards, histories: queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions import scores as S
from ..operators import stats
from .registry import query

_NET = "(correct - wrong * coalesce(negative_mark, 0))"
_BEST = f"""best AS (SELECT *, {_NET} AS net, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY {_NET} DESC, duration_sec, id) AS rn
    FROM attempts WHERE status IN ('finished', 'stopped'))"""
_DONE = "status IN ('finished', 'stopped')"


@query("OP-087 OP-001", f"""
    SELECT quiz_id, count(*) AS attempts, count(DISTINCT user_id) AS users, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, sum(skipped)::BIGINT AS skipped, sum(timeouts)::BIGINT AS timeouts,
           sum(total)::BIGINT AS total_questions, round(coalesce(avg(CASE WHEN total > 0 THEN 100.0::DOUBLE * correct / total END), 0), 6) AS avg_pct
    FROM attempts WHERE {_DONE} GROUP BY quiz_id""")
def quiz_stats(t: Tables) -> DataFrame:
    return stats.quiz_stats(t.attempts)


@query("OP-065 OP-106", f"""
    WITH {_BEST}, placed AS (SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY net DESC, duration_sec, id) AS place FROM best WHERE rn = 1)
    SELECT quiz_id, place, p.user_id, username, first_name, correct, wrong, skipped, total, duration_sec, status, coalesce(negative_mark, 0) AS negative_mark, net
    FROM placed p LEFT JOIN users u ON u.user_id = p.user_id WHERE place <= 10""")
def quiz_leaders(t: Tables) -> DataFrame:
    return stats.leaders(t.attempts, t.users)


@query("OP-105", f"""
    WITH best AS (SELECT *, {_NET} AS net, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY {_NET} DESC, duration_sec, id) AS rn FROM attempts WHERE status = 'finished')
    SELECT quiz_id, user_id, row_number() OVER (PARTITION BY quiz_id ORDER BY net DESC, duration_sec, id) AS rank, count(*) OVER (PARTITION BY quiz_id) AS participants FROM best WHERE rn = 1""")
def user_ranks(t: Tables) -> DataFrame:
    return stats.ranks(t.attempts)


@query("OP-088", f"""
    SELECT user_id, count(*) AS attempts, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, sum(skipped)::BIGINT AS skipped, sum(timeouts)::BIGINT AS timeouts, sum(total)::BIGINT AS total
    FROM attempts WHERE {_DONE} GROUP BY user_id""")
def user_totals(t: Tables) -> DataFrame:
    return stats.user_totals(t.attempts)


@query("OP-066 OP-120", f"""
    WITH r AS (SELECT a.*, q.title, row_number() OVER (PARTITION BY user_id ORDER BY a.id DESC) AS n FROM attempts a LEFT JOIN quizzes q ON q.id = a.quiz_id WHERE a.{_DONE})
    SELECT user_id, n, id, quiz_id, title, status, correct, wrong, total FROM r WHERE n <= 15""")
def user_history(t: Tables) -> DataFrame:
    return stats.user_history(t.attempts, t.quizzes)


@query("OP-064 OP-119", """
    WITH m AS (SELECT a.user_id, q.id AS quiz_id, q.title, q.owner_id, max(a.id) AS last_attempt FROM attempts a JOIN quizzes q ON q.id = a.quiz_id WHERE q.owner_id <> a.user_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_attempt DESC) AS n, (SELECT count(*) FROM questions WHERE questions.quiz_id = m.quiz_id) AS question_count FROM m)
    SELECT * FROM r WHERE n <= 10""")
def recent_played(t: Tables) -> DataFrame:
    return stats.recent_played(t.attempts, t.quizzes, t.questions)


@query("OP-122", f"SELECT user_id, max(id) AS id, arg_max(quiz_id, id) AS quiz_id, arg_max(status, id) AS status FROM attempts WHERE {_DONE} GROUP BY user_id")
def latest_completed_attempt(t: Tables) -> DataFrame:
    return stats.latest_completed(t.attempts)


_ANSWERED = f"""{_DONE} AND (correct + wrong > 0 OR EXISTS (SELECT 1 FROM answers s WHERE s.attempt_id = a.id AND s.chosen_index IS NOT NULL))"""


@query("OP-071", f"SELECT user_id, max(id) AS id, arg_max(status, id) AS status, arg_max(correct, id) AS correct, arg_max(wrong, id) AS wrong FROM attempts a WHERE {_ANSWERED} GROUP BY user_id")
def latest_answered_attempt(t: Tables) -> DataFrame:
    return stats.latest_answered(t.attempts, t.answers)


@query("OP-071", f"SELECT user_id, quiz_id, max(id) AS id, arg_max(status, id) AS status, arg_max(correct, id) AS correct, arg_max(wrong, id) AS wrong FROM attempts a WHERE {_ANSWERED} GROUP BY user_id, quiz_id")
def latest_answered_attempt_of_quiz(t: Tables) -> DataFrame:
    return stats.latest_answered(t.attempts, t.answers, "user_id", "quiz_id")


@query("OP-007 OP-041", "SELECT user_id, max(id) AS id, count(*) AS running FROM attempts WHERE status = 'active' GROUP BY user_id")
def active_attempts(t: Tables) -> DataFrame:
    return stats.active_attempts(t.attempts)


_BOARD = """board AS (SELECT session_id, a.user_id, username, first_name, sum(is_correct)::BIGINT AS correct, sum(1 - is_correct)::BIGINT AS wrong, count(*) AS answered, sum(elapsed::DECIMAL(20,6))::DOUBLE AS elapsed
    FROM group_answers a LEFT JOIN users u ON u.user_id = a.user_id GROUP BY ALL)"""


@query("OP-068 OP-089", f"WITH {_BOARD} SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY correct DESC, elapsed, user_id) AS place FROM board")
def group_leaderboard(t: Tables) -> DataFrame:
    return stats.group_leaderboard(t.group_answers, t.users)


@query("OP-107 OP-152 OP-093", f"""
    WITH {_BOARD}, d AS (SELECT b.*, s.negative_mark, CASE WHEN s.status = 'stopped' THEN CASE WHEN s.asked > 0 THEN s.asked ELSE s.total END ELSE s.total END AS denom,
        correct - wrong * coalesce(s.negative_mark, 0) AS net FROM board b JOIN group_sessions s ON s.id = b.session_id)
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN negative_mark > 0 THEN net ELSE correct END DESC, correct DESC, elapsed, user_id) AS place, user_id,
           coalesce(nullif(first_name, ''), '@' || nullif(username, ''), 'User ' || user_id) AS name, correct, wrong, greatest(0, denom - answered) AS skipped, denom,
           CASE WHEN negative_mark > 0 THEN round(net, 2) END AS net, round(100.0::DOUBLE * correct / denom, 2) AS pct FROM d""")
def group_result(t: Tables) -> DataFrame:
    return stats.group_results(t.group_sessions, t.group_answers, t.users)


@query("OP-069 OP-090", f"""
    SELECT s.quiz_id, count(DISTINCT s.id) AS sessions, count(DISTINCT s.chat_id) AS groups, count(DISTINCT a.user_id) AS participants
    FROM group_sessions s LEFT JOIN group_answers a ON a.session_id = s.id WHERE s.{_DONE} GROUP BY s.quiz_id""")
def group_quiz_stats(t: Tables) -> DataFrame:
    return stats.group_quiz_stats(t.group_sessions, t.group_answers)


@query("OP-070 OP-121", f"""
    WITH p AS (SELECT DISTINCT user_id FROM group_answers UNION SELECT started_by FROM group_sessions),
    r AS (SELECT p.user_id, s.id, q.title AS quiz_title, s.status, (SELECT count(*) FROM group_answers a WHERE a.session_id = s.id AND a.user_id = p.user_id) AS user_answered
          FROM p JOIN group_sessions s ON s.{_DONE} AND (s.started_by = p.user_id OR EXISTS (SELECT 1 FROM group_answers a WHERE a.session_id = s.id AND a.user_id = p.user_id))
          LEFT JOIN quizzes q ON q.id = s.quiz_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN user_answered > 0 THEN 0 ELSE 1 END, id DESC) AS n FROM r)
    SELECT user_id, n, id, quiz_title, status, user_answered FROM n WHERE n <= 10""")
def user_group_history(t: Tables) -> DataFrame:
    return stats.user_group_history(t.group_sessions, t.group_answers, t.quizzes)


@query("OP-072", f"""
    WITH r AS (SELECT DISTINCT a.user_id, s.quiz_id, s.id, s.status FROM group_sessions s JOIN group_answers a ON a.session_id = s.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, quiz_id ORDER BY CASE WHEN {_DONE} THEN 0 ELSE 1 END, id DESC) AS n FROM r)
    SELECT user_id, quiz_id, id, status FROM n WHERE n = 1""")
def latest_group_session(t: Tables) -> DataFrame:
    return stats.latest_group_session(t.group_sessions, t.group_answers)


@query("OP-037 OP-063", """
    SELECT q.id, title, owner_id, status, coalesce(timer, 30) AS timer, coalesce(shuffle_questions, 0) AS shuffle_questions, coalesce(shuffle_options, 0) AS shuffle_options,
           (SELECT count(*) FROM questions x WHERE x.quiz_id = q.id) AS question_count FROM quizzes q LEFT JOIN quiz_settings s ON s.quiz_id = q.id""")
def quizzes_with_settings(t: Tables) -> DataFrame:
    return stats.quizzes_with_settings(t.quizzes, t.quiz_settings, t.questions)


@query("OP-073 OP-091", """
    SELECT series_id, part_no, q.id, status, count(x.id) AS question_count, min(source_number) AS first_number, max(source_number) AS last_number
    FROM quizzes q LEFT JOIN questions x ON x.quiz_id = q.id WHERE series_id IS NOT NULL GROUP BY ALL""")
def series_parts(t: Tables) -> DataFrame:
    return stats.series_parts(t.quizzes, t.questions)


@query("OP-111", """
    SELECT id, (SELECT n.id FROM quizzes n WHERE n.series_id = q.series_id AND n.part_no > q.part_no AND n.status = 'ready' ORDER BY n.part_no LIMIT 1) AS next_id FROM quizzes q WHERE series_id IS NOT NULL""")
def next_parts(t: Tables) -> DataFrame:
    return stats.next_parts(t.quizzes)


@query("OP-074 OP-123", "SELECT owner_id, q.id, title, status, (SELECT count(*) FROM questions x WHERE x.quiz_id = q.id) AS question_count FROM quizzes q WHERE status <> 'archived'")
def owner_quizzes(t: Tables) -> DataFrame:
    return stats.owner_quizzes(t.quizzes, t.questions)


@query("OP-075", "SELECT name, (SELECT count(*) FROM batch_members m WHERE m.batch_name = b.name) AS members FROM batches b")
def batch_sizes(t: Tables) -> DataFrame:
    return stats.batch_sizes(t.batches, t.batch_members)


@query("OP-093 OP-142", """
    SELECT id, correct, wrong, skipped, greatest(0, total - correct - wrong - skipped) AS unanswered, CASE WHEN total > 0 THEN round(100.0::DOUBLE * correct / total, 2) ELSE 0 END AS percentage,
           least(timeouts, skipped) AS timeouts, round(correct - wrong * coalesce(negative_mark, 0), 2)::DOUBLE AS net FROM attempts""")
def attempt_results(t: Tables) -> DataFrame:
    return stats.results(t.attempts)


@query("OP-092 OP-102", "SELECT 'quizzes' AS name, count(*) AS rows FROM quizzes UNION ALL SELECT 'questions', count(*) FROM questions UNION ALL SELECT 'attempts', count(*) FROM attempts")
def dashboard_counts(t: Tables) -> DataFrame:
    return stats.table_counts(quizzes=t.quizzes, questions=t.questions, attempts=t.attempts)


@query("OP-143 OP-144 OP-145 OP-150 OP-151 OP-153 OP-154 OP-155", f"""
    WITH x AS (SELECT a.*, u.username, u.first_name, CASE negative_mark WHEN 0.25 THEN '1/4' WHEN 0.5 THEN '1/2' WHEN 1 THEN '1' ELSE '' END AS label,
        round(correct - wrong * coalesce(negative_mark, 0), 2) AS net, duration_sec::BIGINT AS s FROM attempts a LEFT JOIN users u ON u.user_id = a.user_id WHERE {_DONE}),
    y AS (SELECT *, CASE WHEN net = floor(net) THEN net::BIGINT::VARCHAR ELSE printf('%.2f', net) END AS shown, CASE WHEN total > 0 THEN printf('%.1f%%', round(100.0::DOUBLE * correct / total, 1)) ELSE '0%' END AS pct,
        CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM x)
    SELECT id, coalesce('@' || nullif(username, ''), nullif(first_name, ''), 'User ' || user_id) AS name, shown AS net, label, pct, duration,
        '• ' || correct || '/' || total || ' (' || pct || ') ✅' || correct || ' ❌' || wrong || ' ⏭' || skipped || ' ⏰' || timeouts || CASE WHEN label <> '' THEN ' • Net ' || shown || ' (-' || label || ')' ELSE '' END
        || ' • ' || duration || ' • ' || strftime(finished_at, '%Y-%m-%d %H:%M') || CASE WHEN status = 'stopped' THEN ' (stopped)' ELSE '' END AS line FROM y""")
def history_lines(t: Tables) -> DataFrame:
    c = F.col
    rows = stats.done(t.attempts).join(t.users, "user_id", "left").withColumn("net", S.net_score(c("correct"), c("wrong"), c("negative_mark")))
    return rows.select(
        "id", S.stats_name(c("username"), c("first_name"), c("user_id")).alias("name"), S.score_text(c("net")).alias("net"), S.negative_label(c("negative_mark")).alias("label"),
        S.percent(c("correct"), c("total")).alias("pct"), S.format_duration(c("duration_sec")).alias("duration"),
        S.history_line(*map(c, ("correct", "wrong", "skipped", "timeouts", "total", "net", "negative_mark", "duration_sec", "finished_at", "status"))).alias("line"))
