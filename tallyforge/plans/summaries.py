"""Texts that users read, and rows by key, with twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import lookups, snapshot, stats, summaries
from .registry import query

#: Attempts that are done, with what their lines show.
_SHOWN = """
    x AS (SELECT a.*, q.title, CASE a.negative_mark WHEN 0.25 THEN '1/4' WHEN 0.5 THEN '1/2' WHEN 1 THEN '1' ELSE '' END AS label, round(correct - wrong * coalesce(a.negative_mark, 0), 2) AS net, duration_sec::BIGINT AS s
          FROM attempts a LEFT JOIN quizzes q ON q.id = a.quiz_id WHERE a.status IN ('finished', 'stopped')),
    y AS (SELECT *, CASE WHEN net = floor(net) THEN net::BIGINT::VARCHAR ELSE printf('%.2f', net) END AS shown, CASE WHEN total > 0 THEN printf('%.1f%%', round(100.0::DOUBLE * correct / total, 1)) ELSE '0%' END AS pct,
        CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM x),
    z AS (SELECT *, CASE WHEN label <> '' THEN ' • Net ' || shown || ' (-' || label || ')' ELSE '' END AS suffix FROM y),
    h AS (SELECT *, '• ' || correct || '/' || total || ' (' || pct || ') ✅' || correct || ' ❌' || wrong || ' ⏭' || skipped || ' ⏰' || timeouts || suffix || ' • ' || duration || ' • ' || strftime(finished_at, '%Y-%m-%d %H:%M')
          || CASE WHEN status = 'stopped' THEN ' (stopped)' ELSE '' END AS line FROM z),
    f AS (SELECT *, correct - wrong * coalesce(negative_mark, 0) AS raw, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY correct - wrong * coalesce(negative_mark, 0) DESC, duration_sec, id) AS best FROM h WHERE status = 'finished'),
    r AS (SELECT quiz_id, user_id, row_number() OVER (PARTITION BY quiz_id ORDER BY raw DESC, duration_sec, id) AS rank, count(*) OVER (PARTITION BY quiz_id) AS n FROM f WHERE best = 1)"""
_NL = " || chr(10) || "


@query("OP-338", f"""
    WITH {_SHOWN}
    SELECT h.id, CASE WHEN status = 'stopped' THEN '⏹ <b>Quiz stopped</b> — partial result saved' ELSE '🏁 <b>The quiz has finished!</b>' END{_NL}''{_NL}'📊 <b>Result</b>'{_NL}'Quiz: ' || title{_NL}'Total: ' || total
        {_NL}'Correct: ' || correct || ' ✅'{_NL}'Wrong: ' || wrong || ' ❌'{_NL}'Skipped: ' || skipped || ' ⌛'{_NL}'Timeout: ' || timeouts || ' ⏰' || CASE WHEN timeouts > 0 THEN ' (Skipped में शामिल)' ELSE '' END
        || CASE WHEN total - correct - wrong - skipped > 0 THEN chr(10) || 'Not attempted: ' || (total - correct - wrong - skipped) ELSE '' END
        {_NL}'Score: ' || correct || '/' || total{_NL}'Percentage: ' || printf('%.2f%%', CASE WHEN total > 0 THEN round(100.0::DOUBLE * correct / total, 2) ELSE 0 END){_NL}'Time: ' || duration
        || CASE WHEN label <> '' THEN chr(10) || 'Negative Marking: -' || label || ' प्रति गलत उत्तर (−' || CASE WHEN wrong * negative_mark = floor(wrong * negative_mark) THEN (wrong * negative_mark)::BIGINT::VARCHAR ELSE printf('%.2f', wrong * negative_mark) END || ')'
            || chr(10) || 'Net Score: <b>' || shown || '/' || total || '</b>' ELSE '' END
        || CASE WHEN status = 'finished' AND r.n > 1 THEN chr(10) || chr(10) || '🏆 आपकी rank (best attempt): ' || r.rank || ' / ' || r.n || ' participants' ELSE '' END AS text
    FROM h LEFT JOIN r ON r.quiz_id = h.quiz_id AND r.user_id = h.user_id""")
def attempt_texts(t: Tables) -> DataFrame:
    return summaries.result_texts(t.attempts, t.quizzes)


@query("OP-337", f"""
    WITH {_SHOWN},
    l AS (SELECT user_id, string_agg('• ' || title || ': ' || correct || '/' || total || ' (' || pct || ')' || suffix || ' • ' || strftime(finished_at, '%Y-%m-%d') || CASE WHEN status = 'stopped' THEN ' ⏹' ELSE '' END, chr(10) ORDER BY id DESC) AS lines
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM h) k WHERE n <= 10 GROUP BY user_id),
    s AS (SELECT user_id, count(*) AS n, sum(correct)::BIGINT AS c, sum(wrong)::BIGINT AS w, sum(skipped)::BIGINT AS k, sum(timeouts)::BIGINT AS o, sum(total)::BIGINT AS t FROM h GROUP BY user_id)
    SELECT user_id, '📊 <b>Quiz Stats</b>'{_NL}''{_NL}'🎮 आपके attempts: ' || n{_NL}'✅ Correct: ' || c || '   ❌ Wrong: ' || w || '   ⏭ Skipped: ' || k || '   ⏰ Timeout: ' || o
        {_NL}'📈 Overall: ' || CASE WHEN t > 0 THEN printf('%.1f%%', 100.0::DOUBLE * c / t) ELSE '0%' END{_NL}''{_NL}'📜 <b>Result history</b>'{_NL}lines AS text
    FROM s JOIN l USING (user_id)""")
def user_overviews(t: Tables) -> DataFrame:
    return summaries.user_overviews(t.attempts, t.quizzes)


@query("OP-336", f"""
    WITH {_SHOWN},
    v AS (SELECT DISTINCT quiz_id, user_id FROM attempts WHERE user_id % 3 = 0),
    l AS (SELECT quiz_id, user_id, string_agg(line, chr(10) ORDER BY id DESC) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY id DESC) AS n FROM h) k WHERE n <= 10 GROUP BY ALL)
    SELECT v.quiz_id, v.user_id, '📊 <b>' || q.title || '</b>' || CASE WHEN r.rank IS NOT NULL THEN chr(10) || chr(10) || '🏆 आपकी rank (best attempt): ' || r.rank || ' / ' || r.n ELSE '' END
        || coalesce(chr(10) || chr(10) || '📜 <b>आपके results</b>' || chr(10) || lines, chr(10) || chr(10) || 'ℹ️ आपने अभी यह quiz पूरा नहीं किया है।') AS text
    FROM v JOIN quizzes q ON q.id = v.quiz_id AND q.owner_id <> v.user_id LEFT JOIN r USING (quiz_id, user_id) LEFT JOIN l USING (quiz_id, user_id)""")
def own_quiz_texts(t: Tables) -> DataFrame:
    return summaries.own_texts(t.quizzes, t.attempts, t.attempts.where("user_id % 3 = 0"))


@query("OP-336", f"""
    WITH {_SHOWN},
    s AS (SELECT quiz_id, count(*) AS n, count(DISTINCT user_id) AS u, sum(correct)::BIGINT AS c, sum(wrong)::BIGINT AS w, sum(skipped)::BIGINT AS k, sum(timeouts)::BIGINT AS o, round(avg(CASE WHEN total > 0 THEN 100.0::DOUBLE * correct / total END), 6) AS p FROM h GROUP BY quiz_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY quiz_id, user_id ORDER BY correct - wrong * coalesce(negative_mark, 0) DESC, duration_sec, id) AS best FROM h),
    t AS (SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY correct - wrong * coalesce(negative_mark, 0) DESC, duration_sec, id) AS place FROM b WHERE best = 1),
    l AS (SELECT quiz_id, string_agg(CASE place WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE place || '.' END || ' ' || coalesce('@' || nullif(username, ''), nullif(first_name, ''), 'User ' || t.user_id) || ' — ' || correct || '/' || total || ' (' || pct || ')' || suffix || ' • ' || duration, chr(10) ORDER BY place) AS lines
          FROM t LEFT JOIN users u ON u.user_id = t.user_id WHERE place <= 10 GROUP BY quiz_id),
    o AS (SELECT quiz_id, string_agg(line, chr(10) ORDER BY id DESC) AS lines FROM (SELECT h.*, row_number() OVER (PARTITION BY h.quiz_id ORDER BY h.id DESC) AS n FROM h JOIN quizzes q ON q.id = h.quiz_id AND q.owner_id = h.user_id) k WHERE n <= 5 GROUP BY quiz_id),
    g AS (SELECT s.quiz_id, count(DISTINCT s.id) AS sessions, count(DISTINCT s.chat_id) AS chats, count(DISTINCT a.user_id) AS people FROM group_sessions s LEFT JOIN group_answers a ON a.session_id = s.id WHERE s.status IN ('finished', 'stopped') GROUP BY s.quiz_id)
    SELECT q.id AS quiz_id, '📊 <b>' || q.title || '</b>'{_NL}''{_NL}'👥 Total attempts: ' || coalesce(n, 0) || ' (' || coalesce(u, 0) || ' users)'{_NL}'✅ Correct answers: ' || coalesce(c, 0){_NL}'❌ Wrong answers: ' || coalesce(w, 0)
        {_NL}'⏭ Skipped: ' || coalesce(k, 0) || ' (⏰ Timeout: ' || coalesce(s.o, 0) || ')'{_NL}'📈 Average score: ' || printf('%.1f', coalesce(p, 0)) || '%'
        || CASE WHEN sessions > 0 THEN chr(10) || chr(10) || '👥 Group quizzes: ' || sessions || ' sessions in ' || chats || CASE WHEN chats = 1 THEN ' group' ELSE ' groups' END || ' · ' || people || ' participants' ELSE '' END
        || coalesce(chr(10) || chr(10) || '🏆 <b>Top users</b>' || chr(10) || l.lines, '') || coalesce(chr(10) || chr(10) || '📜 <b>आपके पिछले results</b>' || chr(10) || o.lines, '') AS text
    FROM quizzes q LEFT JOIN s ON s.quiz_id = q.id LEFT JOIN l ON l.quiz_id = q.id LEFT JOIN o ON o.quiz_id = q.id LEFT JOIN g ON g.quiz_id = q.id""")
def owner_quiz_texts(t: Tables) -> DataFrame:
    return summaries.owner_texts(t.quizzes, t.attempts, t.users, t.group_sessions, t.group_answers)


@query("OP-039", "SELECT user_id, username, first_name FROM users WHERE user_id IN (SELECT user_id FROM events) AND user_id <> 0")
def users_looked_up(t: Tables) -> DataFrame:
    return lookups.looked_up(t.users, t.events, "user_id").select("user_id", "username", "first_name")


@query("OP-357 OP-011", "SELECT chat_id, customers, row_number() OVER (ORDER BY chat_id) AS n FROM (SELECT c_nationkey AS chat_id, count(*) AS customers FROM customer GROUP BY 1) x WHERE chat_id IN (SELECT s_nationkey FROM supplier) AND chat_id <> 0")
def chats_looked_up(t: Tables) -> DataFrame:
    """Chats (nations of customers) that are asked for (nations of suppliers), listed in order."""
    chats = t.customer.groupBy(F.col("c_nationkey").alias("chat_id")).agg(F.count(F.lit(1)).alias("customers"))
    return lookups.listed(lookups.looked_up(chats, t.supplier.select(F.col("s_nationkey").alias("chat_id")), "chat_id"), "chat_id")


def _stored(t: Tables) -> DataFrame:
    """Attempts as they are stored: the order of questions and the shown permutation as JSON, the poll that is shown."""
    order = F.when(F.col("id") % 5 > 0, F.concat(F.lit("["), F.col("id").cast("string"), F.lit(", "), (F.col("id") + 7).cast("string"), F.lit("]")))
    perm = F.when(F.col("id") % 3 == 0, F.concat(F.lit("[1, 0, "), (F.col("id") % 4).cast("string"), F.lit("]"))).when(F.col("id") % 3 == 1, "")
    return t.attempts.select("id", "user_id", "status", order.alias("order_json"), perm.alias("cur_perm_json"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("cur_poll_id"))


@query("OP-040 OP-352", "SELECT id, CASE WHEN id % 5 > 0 THEN [id, id + 7] ELSE []::BIGINT[] END AS questions, CASE WHEN id % 3 = 0 THEN [1, 0, (id % 4)::INTEGER] END AS perm FROM attempts WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND id <> 0")
def attempts_looked_up(t: Tables) -> DataFrame:
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return lookups.decoded_attempts(lookups.looked_up(_stored(t), wanted, "id")).select("id", F.col("order").alias("questions"), F.col("cur_perm").alias("perm"))


@query("OP-042", "SELECT 'p' || id AS poll, id, user_id FROM attempts WHERE status = 'active' AND id % 2 = 0 AND id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def attempts_by_poll(t: Tables) -> DataFrame:
    polls = t.lineitem.where("l_linestatus = 'O'").select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("poll_id"))
    return lookups.attempts_by_poll(_stored(t), polls).select(F.col("cur_poll_id").alias("poll"), "id", "user_id")


@query("OP-346", """
    WITH b AS (SELECT 'section blank' AS rule, count(*) AS n FROM questions WHERE coalesce(trim(section), '') = '' UNION ALL SELECT 'more answers than questions', count(*) FROM attempts WHERE correct + wrong + skipped > 2 UNION ALL SELECT 'mark unknown', count(*) FROM attempts WHERE negative_mark IS NULL),
    t AS (SELECT string_agg(rule || ': ' || n, '; ' ORDER BY n DESC, rule) AS told FROM b WHERE n > 0)
    SELECT '🗄️ <b>Backup status</b>' || chr(10) || 'Records: attempts=' || (SELECT count(*) FROM attempts) || ', questions=' || (SELECT count(*) FROM questions) || ', quizzes=' || (SELECT count(*) FROM quizzes) || ', users=' || (SELECT count(*) FROM users)
        || chr(10) || 'Integrity: ' || CASE WHEN told IS NULL THEN '✅ valid' ELSE '❌ ' || told END AS text FROM t""")
def snapshot_status(t: Tables) -> DataFrame:
    found = snapshot.violations([
        ("section blank", t.questions.where("coalesce(trim(section), '') = ''"), "id"), ("more answers than questions", t.attempts.where("correct + wrong + skipped > 2"), "id"), ("mark unknown", t.attempts.where("negative_mark IS NULL"), "id"),
    ])
    return summaries.status_text(stats.table_counts(quizzes=t.quizzes, questions=t.questions, attempts=t.attempts, users=t.users), found)
