"""Assessment tables derived from the driver's tables, by SQL that Spark and DuckDB read alike.

`Tables(spark, sf_dir).attempts` is a lazy DataFrame; `oracle(sql)` puts the same definitions before a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

#: In order: a definition may use those above it.
DERIVED = {
    "users": """
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS username,
               CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS first_name,
               CASE WHEN c_custkey % 17 = 0 THEN 1 WHEN c_custkey % 19 = 0 THEN NULL ELSE 0 END AS is_banned
        FROM customer""",
    "quizzes": """
        SELECT id, CAST(n * 10 + 1 AS BIGINT) AS owner_id, concat('Quiz ', id) AS title,
               CASE n WHEN 4 THEN 'draft' WHEN 5 THEN 'archived' ELSE 'ready' END AS status, CASE WHEN n <= 4 THEN 'S1' END AS series_id, n AS part_no,
               CASE n WHEN 2 THEN ' Batch' WHEN 3 THEN 'PRIVATE' WHEN 4 THEN 'unknown' WHEN 5 THEN NULL ELSE 'free' END AS access_tier,
               CASE n WHEN 2 THEN 'building' ELSE '' END AS batch_name, CASE n WHEN 1 THEN 'Exam ' WHEN 2 THEN 'practice' WHEN 3 THEN NULL ELSE 'x' END AS quiz_mode,
               CASE n WHEN 1 THEN CAST(0.25 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(0 AS DOUBLE) END AS negative_mark
        FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), (5, '5-LOW')) v(n, id)""",
    "quiz_settings": """
        SELECT quiz_id, timer, shuffle_questions, shuffle_options FROM (VALUES ('1-URGENT', 45, 1, 0), ('2-HIGH', 0, 0, 1), ('4-NOT SPECIFIED', 20, 1, 1)) v(quiz_id, timer, shuffle_questions, shuffle_options)""",
    "questions": """
        SELECT p_partkey AS id, quiz_id, CAST(row_number() OVER (PARTITION BY quiz_id ORDER BY p_partkey) AS INT) AS position, p_name AS question,
               p_brand AS qtype, CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS section,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey * 2 + p_partkey % 3 AS INT) END AS source_number, CAST(p_size % 4 AS INT) AS correct_index
        FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS quiz_id FROM part) p""",
    "answers": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS attempt_id, l_partkey AS question_id, l_linenumber AS position,
               CASE WHEN l_returnflag IN ('R', 'A') THEN CAST(l_suppkey % 4 AS INT) END AS chosen_index, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS correct,
               CASE WHEN l_returnflag = 'R' THEN 'correct' WHEN l_returnflag = 'A' THEN 'wrong' WHEN l_linestatus = 'F' THEN 'skipped' ELSE 'timeout' END AS status, l_quantity AS elapsed
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) l
        WHERE rn = 1""",
    "attempts": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS quiz_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'stopped' ELSE 'active' END AS status,
               o_orderdate AS finished_at, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(0.25 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS negative_mark,
               CAST(coalesce(n.answered, 0) + o_orderkey % 3 AS BIGINT) AS total, coalesce(n.correct, 0) AS correct, coalesce(n.wrong, 0) AS wrong, coalesce(n.skipped, 0) AS skipped,
               coalesce(n.timeouts, 0) AS timeouts, coalesce(n.duration_sec, CAST(0 AS DOUBLE)) AS duration_sec
        FROM orders LEFT JOIN (
            SELECT attempt_id, CAST(count(*) AS BIGINT) AS answered, CAST(sum(CASE WHEN status = 'correct' THEN 1 ELSE 0 END) AS BIGINT) AS correct,
                   CAST(sum(CASE WHEN status = 'wrong' THEN 1 ELSE 0 END) AS BIGINT) AS wrong, CAST(sum(CASE WHEN status IN ('skipped', 'timeout') THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
                   CAST(sum(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END) AS BIGINT) AS timeouts, sum(elapsed) AS duration_sec
            FROM answers GROUP BY attempt_id) n ON n.attempt_id = o_orderkey""",
    "group_events": """
        SELECT event_id, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS session_id, event_type AS question_id,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS q_index, user_id,
               CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS is_correct, CAST(event_id % 4 AS INT) AS chosen_index, value AS elapsed, ts AS answered_ts
        FROM events""",
    "group_answers": """
        SELECT event_id, session_id, question_id, q_index, user_id, is_correct, chosen_index, elapsed, answered_ts
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id, question_id, user_id ORDER BY answered_ts, event_id) AS rn FROM group_events) g WHERE rn = 1""",
    "group_sessions": """
        SELECT session_id AS id, CASE session_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS quiz_id,
               CAST(-1000 - session_id % 3 AS BIGINT) AS chat_id, min(user_id) AS started_by, CASE session_id % 4 WHEN 0 THEN 'stopped' WHEN 1 THEN 'active' ELSE 'finished' END AS status,
               CAST(count(DISTINCT question_id) AS BIGINT) AS asked, CAST(count(DISTINCT question_id) + 1 AS BIGINT) AS total, min(answered_ts) AS started_at, max(answered_ts) AS finished_at,
               CASE session_id % 3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(0 AS DOUBLE) END AS negative_mark
        FROM group_events GROUP BY session_id""",
    "papers": """
        SELECT l_orderkey AS attempt_id, CAST(l_linenumber - 1 AS INT) AS idx, max(l_partkey) AS question_id, CASE WHEN max(l_partkey) % 6 = 0 THEN NULL ELSE CAST(max(l_partkey) % 4 AS INT) END AS correct_index,
               CASE WHEN l_orderkey % 4 = 0 THEN '' WHEN max(l_linestatus) = 'F' THEN '  ' ELSE 'Open' END AS section
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "answer_rows": """
        SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber) AS id,
               l_orderkey AS attempt_id, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_partkey END AS question_id, CAST(l_linenumber - 1 AS INT) AS position,
               CASE WHEN l_returnflag IN ('R', 'A') THEN CAST(l_suppkey % 4 AS INT) END AS chosen_index, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS correct,
               CASE WHEN l_returnflag = 'R' THEN 'correct' WHEN l_returnflag = 'A' THEN 'wrong' WHEN l_linestatus = 'F' THEN 'skipped' ELSE 'timeout' END AS status
        FROM lineitem WHERE l_orderkey % 10 <> 3""",
    "group_papers": """
        SELECT session_id, user_id, idx, CAST(idx + 1 AS BIGINT) AS question_id, CAST((session_id + idx) % 4 AS INT) AS correct_index
        FROM (SELECT DISTINCT session_id, user_id FROM group_events) g CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(idx)""",
    "group_rows": """
        SELECT event_id AS id, session_id, user_id, CASE WHEN event_id % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(q_index + 1 AS BIGINT) END AS question_id, q_index AS position,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE chosen_index END AS chosen_index, is_correct AS correct, '' AS status
        FROM group_events""",
    "numbered": """
        SELECT quiz_id, id, row_number() OVER (PARTITION BY quiz_id ORDER BY id) AS pos, id * 3 + id % 2 AS number FROM questions""",
    "controls": """
        SELECT event_id AS id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'pause' WHEN event_type = 'purchase' THEN 'resume' ELSE 'finish' END AS kind FROM events""",
    "batches": "SELECT DISTINCT c_mktsegment AS name FROM customer",
    "batch_members": "SELECT c_mktsegment AS batch_name, c_custkey AS user_id FROM customer WHERE c_custkey % 4 <> 0",
}
_FROM = re.compile(r"(\b(?:FROM|JOIN)\s+)(" + "|".join(sorted([*BASE, *DERIVED], key=len, reverse=True)) + r")\b", re.IGNORECASE)


class Tables:
    """Lazy DataFrames of the driver's tables and of those derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in DERIVED:
                used = {m[1].lower() for m in _FROM.findall(DERIVED[name])}
                text = _FROM.sub(lambda m: f"{m[1]}{{{m[2]}}}", DERIVED[name])
                self._made[name] = self.spark.sql(text, **{u: getattr(self, u) for u in used})
            elif name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def oracle(sql: str) -> str:
    """sql for DuckDB, with the definitions of the derived tables that it uses."""
    need, todo = set(), [sql]
    while todo:
        for _, name in _FROM.findall(todo.pop()):
            if name.lower() in DERIVED and name.lower() not in need:
                need.add(name.lower())
                todo.append(DERIVED[name.lower()])
    body = sql.strip()
    ctes = [f"{name} AS ({DERIVED[name]})" for name in DERIVED if name in need]
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return "WITH " + ", ".join([*ctes, body])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
