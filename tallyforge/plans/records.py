"""Reports, keyed tables, access, sessions, snapshots and duplicates: queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import access, dedup, reports, sessions, snapshot, tables
from .registry import query

# ------------------------------------------------------------------ scans


@query("OP-006", "SELECT user_id FROM users WHERE coalesce(is_banned, 0) = 0")
def allowed_users(t: Tables) -> DataFrame:
    return t.users.where(F.coalesce("is_banned", F.lit(0)) == 0).select("user_id")


@query("OP-002 OP-004 OP-038 OP-045 OP-351", "SELECT quiz_id, id, position, question, qtype, section, correct_index, count(*) OVER (PARTITION BY quiz_id) AS question_count FROM questions")
def quiz_questions(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.questions.select("quiz_id", "id", "position", "question", "qtype", "section", "correct_index", F.count(F.lit(1)).over(Window.partitionBy("quiz_id")).alias("question_count"))


@query("OP-003 OP-005", "SELECT attempt_id, id, position, status, row_number() OVER (PARTITION BY attempt_id ORDER BY position, id) AS n FROM answers")
def attempt_answers(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.answers.select("attempt_id", "id", "position", "status", F.row_number().over(Window.partitionBy("attempt_id").orderBy("position", "id")).alias("n"))


@query("OP-008 OP-009 OP-043 OP-044 OP-353", "SELECT chat_id, max(id) AS id, count(*) AS running FROM group_sessions WHERE status IN ('active', 'pending') GROUP BY chat_id")
def active_group_sessions(t: Tables) -> DataFrame:
    return t.group_sessions.where(F.col("status").isin("active", "pending")).groupBy("chat_id").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("running"))


@query("OP-012 OP-013 OP-204", "SELECT user_id, username, first_name FROM users")
def visible_columns(t: Tables) -> DataFrame:
    return tables.visible(t.users.select("user_id", "username", "first_name", F.lit("x").alias("API_KEY"), F.lit("y").alias("token")))


# ---------------------------------------------------------------- reports

_PICK = """row_number() OVER (PARTITION BY {k} ORDER BY CASE WHEN chosen_index IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN chosen_index IS NOT NULL THEN -id ELSE id END) AS rn"""
_MATCH = f"""
    q AS (SELECT * FROM (SELECT *, {_PICK.format(k='attempt_id, question_id')} FROM answer_rows WHERE question_id <> 0) x WHERE rn = 1),
    p AS (SELECT * FROM (SELECT *, {_PICK.format(k='attempt_id, position')} FROM answer_rows) x WHERE rn = 1),
    m AS (SELECT b.*, CASE WHEN q.id IS NOT NULL THEN q.chosen_index ELSE p.chosen_index END AS c, CASE WHEN q.id IS NOT NULL THEN q.correct ELSE p.correct END AS flag,
                 CASE WHEN q.id IS NOT NULL THEN q.status ELSE p.status END AS st
          FROM papers b LEFT JOIN q ON q.attempt_id = b.attempt_id AND q.question_id = b.question_id LEFT JOIN p ON p.attempt_id = b.attempt_id AND p.position = b.idx),
    r AS (SELECT *, CASE WHEN c IS NULL OR st IN ('skipped', 'timeout') THEN 'unanswered' WHEN correct_index IS NULL AND flag = 1 OR correct_index = c THEN 'correct' ELSE 'wrong' END AS status FROM m)"""


@query("OP-077 OP-079 OP-200 OP-201", f"""
    WITH {_MATCH} SELECT attempt_id, idx, question_id, CASE WHEN status <> 'unanswered' THEN c END AS chosen, status, coalesce(st IN ('skipped', 'timeout'), false) AS skipped FROM r""")
def attempt_report(t: Tables) -> DataFrame:
    return reports.attempt_report(t.papers, t.answer_rows)


@query("OP-339 OP-340 OP-341 OP-342 OP-410", f"""
    WITH {_MATCH}, s AS (SELECT attempt_id, count(*) AS total, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'wrong') AS incorrect, count(*) FILTER (status = 'unanswered') AS unanswered FROM r GROUP BY attempt_id)
    SELECT s.*, round(100.0::DOUBLE * s.correct / s.total, 2) AS percentage, CASE WHEN negative_mark > 0 THEN round(incorrect * negative_mark, 2) END AS penalty,
           CASE WHEN negative_mark > 0 THEN round(s.correct - incorrect * negative_mark, 2) END AS net, s.correct + incorrect + unanswered = s.total AS consistent
    FROM s LEFT JOIN attempts a ON a.id = s.attempt_id""")
def attempt_report_totals(t: Tables) -> DataFrame:
    marks = t.attempts.select(F.col("id").alias("attempt_id"), "negative_mark")
    return reports.report_totals(reports.attempt_report(t.papers, t.answer_rows), marks, "attempt_id")


@query("OP-078 OP-343", f"""
    WITH q AS (SELECT * FROM (SELECT *, {_PICK.format(k='session_id, user_id, question_id')} FROM group_rows WHERE question_id <> 0) x WHERE rn = 1),
    p AS (SELECT * FROM (SELECT *, {_PICK.format(k='session_id, user_id, position')} FROM group_rows) x WHERE rn = 1),
    m AS (SELECT b.*, CASE WHEN q.id IS NOT NULL THEN q.chosen_index ELSE p.chosen_index END AS c, CASE WHEN q.id IS NOT NULL THEN q.correct ELSE p.correct END AS flag
          FROM group_papers b LEFT JOIN q ON q.session_id = b.session_id AND q.user_id = b.user_id AND q.question_id = b.question_id
          LEFT JOIN p ON p.session_id = b.session_id AND p.user_id = b.user_id AND p.position = b.idx)
    SELECT session_id, user_id, idx, question_id, c AS chosen, CASE WHEN c IS NULL THEN 'unanswered' WHEN flag = 1 OR c = correct_index THEN 'correct' ELSE 'wrong' END AS status FROM m""")
def group_report(t: Tables) -> DataFrame:
    return reports.group_report(t.group_papers, t.group_rows)


@query("OP-077 OP-344 OP-345", """
    WITH has AS (SELECT DISTINCT attempt_id FROM answer_rows), l AS (SELECT user_id, quiz_id, max(id) AS used FROM attempts a WHERE status IN ('finished', 'stopped')
        AND (correct + wrong > 0 OR EXISTS (SELECT 1 FROM answer_rows s WHERE s.attempt_id = a.id AND s.chosen_index IS NOT NULL)) GROUP BY ALL)
    SELECT a.id AS attempt_id, CASE WHEN h.attempt_id IS NOT NULL THEN a.id ELSE coalesce(l.used, a.id) END AS used_id
    FROM attempts a LEFT JOIN has h ON h.attempt_id = a.id LEFT JOIN l ON l.user_id = a.user_id AND l.quiz_id = a.quiz_id""")
def report_targets(t: Tables) -> DataFrame:
    return reports.report_targets(t.attempts, t.answer_rows)


@query("OP-080 OP-094 OP-348", """
    WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id, question_id ORDER BY id DESC) AS rn FROM answer_rows) x WHERE rn = 1),
    n AS (SELECT *, max(trim(section) <> '') OVER (PARTITION BY attempt_id) AS named FROM papers),
    r AS (SELECT n.attempt_id, coalesce(nullif(trim(section), ''), 'General') AS section, coalesce(l.status = 'correct' OR l.correct = 1, false) AS hit, coalesce(l.status = 'wrong', false) AS miss
          FROM n LEFT JOIN l ON l.attempt_id = n.attempt_id AND l.question_id = n.question_id WHERE named),
    g AS (SELECT attempt_id, section, count(*) AS total, count(*) FILTER (hit) AS correct, count(*) FILTER (miss AND NOT hit) AS wrong, count(*) FILTER (NOT miss AND NOT hit) AS skipped FROM r GROUP BY ALL)
    SELECT g.*, round(g.correct - g.wrong * coalesce(a.negative_mark, 0), 2)::DOUBLE AS score FROM g LEFT JOIN attempts a ON a.id = g.attempt_id""")
def section_breakdown(t: Tables) -> DataFrame:
    return reports.section_breakdown(t.papers, t.answer_rows, t.attempts.select(F.col("id").alias("attempt_id"), "negative_mark"))


# ------------------------------------------------------------ keyed tables

_NEW = "SELECT c_custkey AS user_id, c_name || '!' AS username, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'F' || c_custkey END AS first_name FROM customer WHERE c_custkey % 2 = 0"
_OLD = "SELECT c_custkey AS user_id, c_name AS username, 'A' || c_custkey AS first_name FROM customer WHERE c_custkey % 3 <> 0"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("!")).alias("username"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("F"), F.col("c_custkey").cast("string"))).alias("first_name"))
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("first_name"))
    return old, new


@query("OP-273 OP-277 OP-279 OP-286 OP-288 OP-289 OP-295 OP-299 OP-300 OP-302 OP-364", f"""
    WITH o AS ({_OLD}), n AS ({_NEW})
    SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.username, o.username) AS username, CASE WHEN n.user_id IS NULL THEN o.first_name ELSE n.first_name END AS first_name FROM o FULL JOIN n ON n.user_id = o.user_id""")
def upserted(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return tables.upsert(old, new, ["user_id"])


@query("OP-275 OP-276 OP-293 OP-298 OP-034", f"""
    WITH o AS ({_OLD}), n AS ({_NEW})
    SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN n.username ELSE o.username END AS username,
           CASE WHEN o.user_id IS NULL THEN n.first_name WHEN n.user_id IS NULL THEN o.first_name ELSE coalesce(n.first_name, o.first_name) END AS first_name FROM o FULL JOIN n ON n.user_id = o.user_id""")
def upserted_keeping(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return tables.upsert(old, new, ["user_id"], {"first_name": F.coalesce("n.first_name", "o.first_name")})


@query("OP-274 OP-278 OP-281 OP-285", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)")
def inserted_missing(t: Tables) -> DataFrame:
    return tables.insert_missing(*_old_new(t), ["user_id"])


@query("OP-290 OP-292 OP-294 OP-297 OP-301", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def deleted(t: Tables) -> DataFrame:
    return tables.delete(*_old_new(t), ["user_id"])


@query("OP-280 OP-284", "SELECT id, CASE WHEN owner_id = 21 THEN 'archived' ELSE status END AS status, owner_id = 21 AND status <> 'archived' AS changed FROM quizzes")
def archived(t: Tables) -> DataFrame:
    wanted = t.quizzes.where("owner_id = 21").select("id", F.col("status").alias("expected"), F.lit("archived").alias("value"))
    return tables.swapped(t.quizzes.select("id", "status"), wanted, ["id"], "status")


@query("OP-305 OP-304 OP-321 OP-322 OP-324 OP-325 OP-326 OP-327 OP-359", f"""
    WITH o AS ({_OLD}) SELECT user_id, CASE WHEN user_id % 5 = 0 AND first_name = 'A' || (user_id - user_id % 2) THEN 'set' ELSE first_name END AS first_name, user_id % 5 = 0 AND user_id % 2 = 0 AS changed FROM o""")
def compared_and_set(t: Tables) -> DataFrame:
    old, _ = _old_new(t)
    wanted = old.where("user_id % 5 = 0").select("user_id", F.concat(F.lit("A"), (F.col("user_id") - F.col("user_id") % 2).cast("string")).alias("expected"), F.lit("set").alias("value"))
    return tables.swapped(old.select("user_id", "first_name"), wanted, ["user_id"], "first_name")


@query("OP-303 OP-358 OP-356 OP-057", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_request(t: Tables) -> DataFrame:
    return tables.latest_of(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts")


@query("OP-270 OP-373 OP-269", f"""
    WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT o.user_id AS a, n.user_id AS b, o.username IS NOT DISTINCT FROM n.username AND o.first_name IS NOT DISTINCT FROM n.first_name AS same FROM o FULL JOIN n ON n.user_id = o.user_id)
    SELECT CASE WHEN a IS NULL THEN 'inserted' WHEN b IS NULL THEN 'live only' WHEN same THEN 'unchanged' ELSE 'updated' END AS kind, count(*) AS rows FROM j GROUP BY 1""")
def restore_plan(t: Tables) -> DataFrame:
    return tables.restore_plan(*_old_new(t), ["user_id"])


@query("OP-109", "SELECT id, quiz_id, row_number() OVER (PARTITION BY quiz_id ORDER BY position, id)::INTEGER AS position FROM questions WHERE id % 10 <> 3")
def question_deleted(t: Tables) -> DataFrame:
    return tables.without_questions(t.questions, t.questions.where("id % 10 = 3")).select("id", "quiz_id", "position")


@query("OP-108", """
    SELECT id, quiz_id, CASE WHEN position = 3 AND q > 3 THEN 4 WHEN position = 4 THEN 3 ELSE position END::INTEGER AS position FROM (SELECT *, count(*) OVER (PARTITION BY quiz_id) AS q FROM questions) x""")
def question_moved(t: Tables) -> DataFrame:
    return tables.moved(t.questions, t.questions.where("position = 3").select("id", F.lit(1).alias("delta"))).select("id", "quiz_id", "position")


@query("OP-110 OP-282 OP-307", """
    WITH m AS (SELECT quiz_id, max(position) AS last, count(*) AS have FROM questions GROUP BY quiz_id),
    n AS (SELECT quiz_id, id AS n, question FROM questions WHERE id % 7 = 0)
    SELECT n.quiz_id, n.n, n.question, (last + row_number() OVER (PARTITION BY n.quiz_id ORDER BY n.n))::INTEGER AS position, have + count(*) OVER (PARTITION BY n.quiz_id) > 500 AS refused FROM n JOIN m ON m.quiz_id = n.quiz_id""")
def questions_appended(t: Tables) -> DataFrame:
    return tables.appended(t.questions, t.questions.where("id % 7 = 0").select("quiz_id", F.col("id").alias("n"), "question"))


@query("OP-140 OP-329 OP-035", """
    WITH l AS (SELECT event_id AS event_key, user_id, event_type AS sha, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'sent' END AS status FROM events WHERE event_id % 50 = 0),
    f AS (SELECT event_id AS event_key, user_id, event_type AS sha, ts FROM events e WHERE event_id NOT IN (SELECT event_key FROM l)
          AND NOT EXISTS (SELECT 1 FROM l WHERE l.status <> 'failed' AND l.user_id = e.user_id AND l.sha = e.event_type))
    SELECT event_key, user_id, sha AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sha ORDER BY ts, event_key) AS n FROM f) x WHERE n = 1""")
def upload_claims(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("event_key"), "user_id", F.col("event_type").alias("sha256"), F.lit(1).alias("target"), F.col("ts").alias("at"))
    ledger = rows.where("event_key % 50 = 0").withColumn("status", F.when(F.col("event_key") % 3 == 0, "failed").otherwise("sent"))
    return tables.claims(ledger, rows).select("event_key", "user_id", "sha256")


# ---------------------------------------------------------------- access

_MODE = "CASE WHEN lower(trim(quiz_mode)) IN ('standard', 'practice', 'exam', 'sectional') THEN lower(trim(quiz_mode)) ELSE 'standard' END"
_TIER = "CASE WHEN lower(trim(access_tier)) IN ('free', 'batch', 'private') THEN lower(trim(access_tier)) ELSE 'free' END"


@query("OP-051 OP-052 OP-146 OP-366", f"""
    SELECT id, {_MODE} AS mode, {_TIER} AS tier, CASE {_MODE} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in access.MODE_LABELS.items())} END AS mode_label,
           CASE {_TIER} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in access.TIER_LABELS.items())} END || CASE WHEN {_TIER} = 'batch' AND batch_name <> '' THEN ' (' || batch_name || ')' ELSE '' END AS tier_label FROM quizzes""")
def quiz_labels(t: Tables) -> DataFrame:
    c = F.col
    return t.quizzes.select("id", access.normalize_mode(c("quiz_mode")).alias("mode"), access.normalize_tier(c("access_tier")).alias("tier"), access.mode_label(c("quiz_mode")).alias("mode_label"), access.tier_label(c("access_tier"), c("batch_name")).alias("tier_label"))


@query("OP-048 OP-050 OP-058 OP-059 OP-062 OP-357 OP-104", f"""
    WITH a AS (SELECT DISTINCT user_id, CASE WHEN id % 2 = 0 THEN user_id ELSE -1000 - id % 4 END AS chat_id, quiz_id FROM attempts),
    m AS (SELECT DISTINCT user_id, lower(batch_name) AS b FROM batch_members),
    q AS (SELECT *, {_TIER} AS tier, CASE WHEN part_no = 1 THEN [-1001, -1002] ELSE [] END AS chats, trim(batch_name) AS batch, CASE WHEN trim(batch_name) = '' THEN 'default' ELSE lower(trim(batch_name)) END AS need FROM quizzes),
    r AS (SELECT a.*, CASE WHEN owner_id = a.user_id THEN '' WHEN len(chats) > 0 AND a.chat_id <> a.user_id AND NOT list_contains(chats, a.chat_id) AND a.chat_id <> -1003 THEN 'chat'
            WHEN tier = 'private' THEN 'private' WHEN (tier = 'batch' OR batch <> '') AND m.user_id IS NULL AND NOT (a.chat_id <> a.user_id AND a.chat_id = -1003 AND need = 'building') THEN 'batch' ELSE '' END AS reason
          FROM a JOIN q ON q.id = a.quiz_id LEFT JOIN m ON m.user_id = a.user_id AND m.b = q.need)
    SELECT user_id, chat_id, quiz_id, reason = '' AS allowed, reason FROM r""")
def access_checks(t: Tables) -> DataFrame:
    asked = t.attempts.select("user_id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(-1000 - F.col("id") % 4).alias("chat_id"), "quiz_id").distinct()
    quizzes = t.quizzes.withColumn("allowed_chats", F.when(F.col("part_no") == 1, F.array(F.lit(-1001).cast("long"), F.lit(-1002).cast("long"))).otherwise(F.array().cast("array<long>")))
    chats = t.spark.range(1).select(F.lit(-1003).cast("long").alias("chat_id"), F.lit("Building").alias("batch_name"))
    return access.check_access(asked, quizzes, t.batch_members, chats)


@query("OP-049", f"SELECT DISTINCT a.user_id, quiz_id, q.status = 'ready' AND ({_TIER} <> 'private' OR owner_id = a.user_id) AS allowed FROM attempts a JOIN quizzes q ON q.id = a.quiz_id")
def share_checks(t: Tables) -> DataFrame:
    c = F.col
    rows = t.attempts.select("user_id", "quiz_id").distinct().join(t.quizzes.withColumnRenamed("id", "quiz_id"), "quiz_id")
    return rows.select("user_id", "quiz_id", access.share_allowed(c("owner_id"), c("user_id"), c("status"), c("access_tier"), F.lit(False)).alias("allowed"))


@query("OP-060 OP-061 OP-291", "SELECT batch_name, user_id, row_number() OVER (PARTITION BY batch_name ORDER BY user_id) AS n FROM batch_members WHERE lower(batch_name) = lower('Machinery')")
def batch_members_of(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.batch_members.where(F.lower("batch_name") == "machinery").select("batch_name", "user_id", F.row_number().over(Window.partitionBy("batch_name").orderBy("user_id")).alias("n"))


# --------------------------------------------------------------- sessions


@query("OP-311 OP-309", "SELECT session_id, question_id, user_id, event_id, answered_ts FROM group_answers")
def first_answers(t: Tables) -> DataFrame:
    return sessions.first_wins(t.group_events.select("session_id", "question_id", "user_id", "answered_ts", "event_id"), ["session_id", "question_id", "user_id"], "answered_ts", "event_id")


@query("OP-310", """
    WITH p AS (SELECT session_id, question_id, min(answered_ts) AS s, min(answered_ts) + INTERVAL 6 HOUR AS c FROM group_events GROUP BY ALL)
    SELECT e.event_id, e.session_id FROM group_events e JOIN p USING (session_id, question_id) WHERE e.answered_ts >= s AND e.answered_ts < c""")
def answers_in_time(t: Tables) -> DataFrame:
    polls = t.group_events.groupBy("session_id", "question_id").agg(F.min("answered_ts").alias("sent_at")).withColumn("closed_at", F.col("sent_at") + F.expr("INTERVAL 6 HOURS"))
    return sessions.in_time(t.group_events, polls).select("event_id", "session_id")


_RUNS = """n AS (SELECT user_id, a.status IN ('skipped', 'timeout') AS miss, row_number() OVER (PARTITION BY user_id ORDER BY attempt_id, position, a.id) AS n FROM answers a JOIN attempts t ON t.id = a.attempt_id),
    i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, miss ORDER BY n) AS island FROM n),
    s AS (SELECT user_id, count(*) AS streak, min(n) AS start, max(n) AS "end" FROM i WHERE miss GROUP BY user_id, island)"""


def _user_answers(t: Tables) -> DataFrame:
    return t.answers.join(t.attempts.select(F.col("id").alias("attempt_id"), "user_id"), "attempt_id")


@query("OP-317 OP-318 OP-076 OP-312", f'WITH {_RUNS} SELECT user_id, streak, start, "end" FROM s')
def miss_streaks(t: Tables) -> DataFrame:
    return sessions.miss_streaks(_user_answers(t), "user_id", "attempt_id", "position", "id")


@query("OP-317", f"WITH {_RUNS} SELECT user_id, sum(streak // 5)::BIGINT AS pauses FROM s GROUP BY user_id HAVING sum(streak // 5) > 0")
def auto_pauses(t: Tables) -> DataFrame:
    return sessions.auto_pauses(_user_answers(t), "user_id", "attempt_id", "position", "id")


@query("OP-320 OP-322", """
    WITH l AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY ts, id), 'resume') AS was FROM controls WHERE kind IN ('pause', 'resume')),
    u AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS till FROM l WHERE kind <> was)
    SELECT user_id, count(till) AS pauses, coalesce(sum(epoch_us(till) - epoch_us(ts)), 0)::BIGINT AS paused_us FROM u WHERE kind = 'pause' GROUP BY user_id""")
def pause_totals(t: Tables) -> DataFrame:
    return sessions.pauses(t.controls, "user_id")


@query("OP-118", """
    SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window,
           epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS since_us FROM events""")
def rolling_quota(t: Tables) -> DataFrame:
    return sessions.quota(t.events)


@query("OP-114", """
    WITH n AS (SELECT quiz_id, number, lead(number) OVER (PARTITION BY quiz_id ORDER BY pos) AS after FROM numbered)
    SELECT quiz_id, unnest(generate_series(number + 1, after - 1))::BIGINT AS missing FROM n WHERE after > number + 1""")
def number_gaps(t: Tables) -> DataFrame:
    return sessions.number_gaps(t.numbered, "quiz_id")


@query("OP-083 OP-247", """
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::VARCHAR AS heading FROM events""")
def nearest_heading(t: Tables) -> DataFrame:
    lines = t.events.select("user_id", F.struct("ts", "event_id").alias("pos"), F.col("event_id").cast("string").alias("text"), "event_type", "event_id")
    return sessions.headings(lines, "user_id", F.col("event_type") == "signup").select("user_id", "event_id", "heading")


@query("OP-313 OP-314", "SELECT user_id, arg_min(id, (ts, id)) AS id FROM controls WHERE kind = 'finish' GROUP BY user_id")
def terminal_events(t: Tables) -> DataFrame:
    return sessions.terminal(t.controls, "user_id", ["finish"]).select("user_id", "id")


@query("OP-330 OP-331", "SELECT id FROM group_sessions WHERE status = 'active' AND epoch_us(TIMESTAMP '2024-01-20') - epoch_us(started_at) > 86400000000")
def expired_sessions(t: Tables) -> DataFrame:
    return sessions.expired(t.group_sessions.withColumn("paused_us", F.lit(None).cast("long")), F.to_timestamp(F.lit("2024-01-20"))).select("id")


@query("OP-320 OP-308", "SELECT event_id, greatest(0, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) + event_id % 5 AS elapsed_us FROM events")
def answer_times(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag(sessions.micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    took = sessions.answered_elapsed(before, sessions.micros("ts"), F.col("event_id") % 5)
    return t.events.select("event_id", F.when(before.isNotNull(), took).otherwise(F.col("event_id") % 5).alias("elapsed_us"))


# -------------------------------------------------------------- snapshots


@query("OP-085 OP-264", """
    SELECT q.id AS quiz_id, count(x.id) AS questions, min(x.position) AS first_position, max(x.position) AS last_position, sum(x.id)::BIGINT AS ids FROM quizzes q LEFT JOIN questions x ON x.quiz_id = q.id GROUP BY q.id""")
def nested_quizzes(t: Tables) -> DataFrame:
    """In chunks of a thousand questions, counted over them."""
    nested = snapshot.nest(t.quizzes.select("id"), t.questions.select("quiz_id", "position", "id"), "id", "quiz_id", "questions", "position", "id", size=1000)
    c = F.col("questions")
    return nested.groupBy(F.col("id").alias("quiz_id")).agg(
        F.sum(F.size(c)).alias("questions"), F.min(F.get(c, F.lit(0))["position"]).alias("first_position"), F.max(F.try_element_at(c, F.lit(-1))["position"]).alias("last_position"),
        F.sum(F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["id"]))).alias("ids"))


@query("OP-085 OP-264", "SELECT quiz_id, ((position - 1) // 100)::INTEGER AS chunk, list(id ORDER BY position, id) AS ids FROM questions GROUP BY ALL")
def nested_chunks(t: Tables) -> DataFrame:
    """Questions are numbered without a gap, so every hundred positions are a chunk."""
    nested = snapshot.nest(t.quizzes.select("id"), t.questions.select("quiz_id", "position", "id"), "id", "quiz_id", "questions", "position", "id", size=100)
    return nested.where(F.size("questions") > 0).select(F.col("id").alias("quiz_id"), "chunk", F.transform("questions", lambda x: x["id"]).alias("ids"))


@query("OP-085 OP-264", "SELECT id, quiz_id, position, question FROM questions")
def nested_and_back(t: Tables) -> DataFrame:
    children = t.questions.select("quiz_id", "position", "id", "question")
    nested = snapshot.nest(t.quizzes.select(F.col("id").alias("quiz")), children, "quiz", "quiz_id", "questions", "position", "id", size=100)
    return snapshot.unnest(nested, "questions", "quiz").select("id", F.col("quiz").alias("quiz_id"), "position", "question")


@query("OP-084 OP-272 OP-141", """
    WITH g AS (SELECT id FROM quizzes WHERE part_no < 4), l AS (SELECT quiz_id, 'a' AS k, id FROM attempts UNION ALL SELECT quiz_id, 's', id FROM group_sessions)
    SELECT quiz_id, count(*) FILTER (k = 'a') AS attempts, count(*) FILTER (k = 's') AS group_sessions, min(id) FILTER (k = 'a') AS first_attempt FROM l WHERE quiz_id NOT IN (SELECT id FROM g) GROUP BY quiz_id""")
def missing_quizzes(t: Tables) -> DataFrame:
    found = snapshot.missing_inventory(t.quizzes.where("part_no < 4"), t.attempts, t.group_sessions)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    count = lambda kind: F.coalesce(F.sum(of(kind, F.size("ids"))), F.lit(0))
    return found.groupBy("quiz_id").agg(count("attempt").alias("attempts"), count("session").alias("group_sessions"), F.min(of("attempt", F.get("ids", F.lit(0)))).alias("first_attempt"))


@query("OP-086 OP-265 OP-266", """
    WITH x AS (SELECT *, CASE WHEN id % 50 = 7 THEN '  ' WHEN id % 50 = 8 THEN NULL ELSE question END AS q, CASE WHEN id % 100 = 5 THEN 1 ELSE 3 END AS n_options FROM questions), k AS (SELECT id FROM quizzes WHERE part_no <> 5),
    n AS (SELECT attempt_id, count(*) AS n FROM answers GROUP BY 1)
    SELECT 'question empty' AS rule, id::VARCHAR AS record FROM x WHERE coalesce(trim(q), '') = ''
    UNION ALL SELECT 'answer outside options', id::VARCHAR FROM x WHERE correct_index >= n_options UNION ALL SELECT 'too few options', id::VARCHAR FROM x WHERE n_options < 2
    UNION ALL SELECT 'attempt of unknown quiz', id::VARCHAR FROM attempts WHERE quiz_id NOT IN (SELECT id FROM k)
    UNION ALL SELECT 'more answers than questions', a.id::VARCHAR FROM attempts a JOIN n ON n.attempt_id = a.id WHERE total > 0 AND n > total
    UNION ALL SELECT 'answer of unknown attempt', id::VARCHAR FROM answers WHERE attempt_id NOT IN (SELECT id FROM attempts)""")
def snapshot_violations(t: Tables) -> DataFrame:
    questions = t.questions.withColumn("question", F.when(F.col("id") % 50 == 7, "  ").when(F.col("id") % 50 != 8, F.col("question"))).withColumn("n_options", F.when(F.col("id") % 100 == 5, 1).otherwise(3))
    return snapshot.snapshot_checks(t.quizzes.where("part_no <> 5"), questions, t.attempts, t.answers)


@query("OP-268", "SELECT id, quiz_id, status, NULL::BIGINT AS user_id, true AS redacted FROM attempts")
def redacted_attempts(t: Tables) -> DataFrame:
    return snapshot.redact(t.attempts.select("id", "quiz_id", "status", "user_id"))


@query("OP-268", "SELECT is_banned, 'u' || (row_number() OVER (ORDER BY user_id) - 1) AS user_ref FROM users")
def user_refs(t: Tables) -> DataFrame:
    return snapshot.user_refs(t.users)


@query("OP-269 OP-102", """
    SELECT 'attempts' AS name, (SELECT count(*) FROM attempts WHERE id % 2 = 0) AS declared, (SELECT count(*) FROM attempts) AS actual UNION ALL SELECT 'users', NULL, (SELECT count(*) FROM users) UNION ALL SELECT 'gone', 5, NULL""")
def count_mismatches(t: Tables) -> DataFrame:
    from ..operators.stats import table_counts

    declared = table_counts(attempts=t.attempts.where("id % 2 = 0"), quizzes=t.quizzes).unionByName(t.spark.range(1).select(F.lit("gone").alias("name"), F.lit(5).cast("long").alias("rows")))
    return snapshot.count_mismatches(declared, table_counts(attempts=t.attempts, users=t.users, quizzes=t.quizzes))


@query("OP-103 OP-029 OP-371 OP-372", "SELECT count(*) AS rows, true AS same_in_any_order, false AS same_when_changed FROM users")
def content_hashes(t: Tables) -> DataFrame:
    a = snapshot.content_hash(t.users)
    b = snapshot.content_hash(t.users.repartition(7, "username").withColumn("generated_at", F.current_timestamp())).withColumnRenamed("digest", "d2")
    c = snapshot.content_hash(t.users.withColumn("is_banned", F.when(F.col("user_id") == 3, 5).otherwise(F.col("is_banned")))).withColumnRenamed("digest", "d3")
    return a.join(b, "rows").join(c, "rows").select("rows", (F.col("digest") == F.col("d2")).alias("same_in_any_order"), (F.col("digest") == F.col("d3")).alias("same_when_changed"))


# ------------------------------------------------------------- duplicates


@query("OP-131 OP-132 OP-096", """
    WITH s AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || '|' || lower(p_type) || '|' || p_brand || '|' || p_size % 4 AS sig, p_partkey // 100 AS file_no FROM part),
    f AS (SELECT sig, min(file_no) AS first FROM s GROUP BY sig)
    SELECT file_no, count(*) AS n FROM s JOIN f USING (sig) WHERE file_no > first GROUP BY file_no""")
def cross_file_duplicates(t: Tables) -> DataFrame:
    sig = dedup.signature(F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")), F.array("p_type", "p_brand"), (F.col("p_size") % 4).cast("int"))
    rows = t.part.select(sig.alias("sig"), F.expr("p_partkey div 100").alias("file_no"))
    return dedup.cross_file_duplicates(rows).groupBy("file_no").agg(F.sum("n").alias("n"))


@query("OP-133", "SELECT doc_id AS file_no, sha256(text) AS sha256, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def distinct_files(t: Tables) -> DataFrame:
    return dedup.distinct_files(t.documents.select(F.col("doc_id").alias("file_no"), F.sha2("text", 256).alias("sha256")))


@query("OP-124 OP-125", """
    WITH p AS (SELECT *, (row_number() OVER (PARTITION BY quiz_id ORDER BY position, id) - 1) // 150 + 1 AS part FROM questions)
    SELECT quiz_id, part::INTEGER AS part, arg_min(id, position) AS first, arg_max(id, position) AS last, count(*) AS n FROM p GROUP BY quiz_id, part""")
def part_ranges(t: Tables) -> DataFrame:
    return dedup.part_ranges(dedup.parts(t.questions, 150))


@query("OP-137", """
    WITH s AS (SELECT quiz_id, trim(section) AS section, min(position) AS pos FROM questions WHERE trim(section) <> '' GROUP BY ALL UNION ALL SELECT quiz_id, 'Timed', 2147483647 FROM quiz_settings)
    SELECT quiz_id, row_number() OVER (PARTITION BY quiz_id ORDER BY pos, section) AS n, section FROM s""")
def quiz_sections(t: Tables) -> DataFrame:
    return dedup.ordered_sections(t.questions, t.quiz_settings.select("quiz_id", F.lit(" Timed ").alias("section")))


@query("OP-097", """
    WITH q AS (SELECT quiz_id AS doc_id, id AS number, CASE WHEN id % 23 = 0 THEN 5 WHEN quiz_id = '5-LOW' THEN 2 + id % 2 ELSE 4 END AS n_options FROM questions),
    g AS (SELECT doc_id, n_options, count(*) AS c FROM q GROUP BY doc_id, n_options), c AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS every FROM g), u AS (SELECT doc_id, n_options AS usual FROM c WHERE 2 * c > every)
    SELECT q.doc_id, number, n_options::INTEGER AS n_options, usual::INTEGER AS usual FROM q JOIN u USING (doc_id) WHERE n_options <> usual""")
def odd_option_counts(t: Tables) -> DataFrame:
    n = F.when(F.col("id") % 23 == 0, 5).when(F.col("quiz_id") == "5-LOW", (2 + F.col("id") % 2).cast("int")).otherwise(4)
    return dedup.odd_option_counts(t.questions.select(F.col("quiz_id").alias("doc_id"), F.col("id").alias("number"), n.alias("n_options")))


@query("OP-139 OP-116", """
    SELECT quiz_id AS doc_id, number FROM numbered WHERE (quiz_id, number) NOT IN (SELECT quiz_id, number FROM numbered WHERE id % 3 = 0)""")
def unused_keys(t: Tables) -> DataFrame:
    keys = t.numbered.select(F.col("quiz_id").alias("doc_id"), "number", "id")
    return dedup.unused_keys(keys.drop("id"), keys.where("id % 3 = 0"))
