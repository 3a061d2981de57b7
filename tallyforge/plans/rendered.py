"""Settings, layout and rendering over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..functions import render as R
from ..operators import settings
from ..sources import layout as L
from .registry import query


@query("OP-025 OP-026 OP-363", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE 20 END::INTEGER AS value, c_custkey % 4 = 1 AS rejected FROM customer""")
def number_settings(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).when(k == 1, "many").when(k == 2, " ")
    value, bad = settings.number_setting(raw, 20)
    return t.customer.select("c_custkey", value.alias("value"), bad.alias("rejected"))


@query("OP-055 OP-360 OP-361 OP-362 OP-010", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'own' WHEN user_id % 4 = 1 THEN 'builtin_checked' ELSE 'base' END AS format_id FROM users")
def import_formats(t: Tables) -> DataFrame:
    one = t.spark.range(1)
    formats = one.select(F.explode(F.array(F.lit("own"), F.lit("base"))).alias("id"), F.lit("import").alias("kind"))
    chosen = F.when(F.col("user_id") % 4 == 0, "own").when(F.col("user_id") % 4 == 1, "builtin_checked").when(F.col("user_id") % 4 == 2, "gone")
    stored = one.select(F.lit("default_format_import").alias("key"), F.lit("base").alias("value"))
    return settings.import_formats(t.users.select("user_id", chosen.alias("txt_import_format_id")), stored, formats)


@query("OP-053 OP-054 OP-354 OP-369", """
    SELECT user_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 5 = 0 THEN false ELSE user_id % 7 = 0 END AS inside FROM users""")
def memberships(t: Tables) -> DataFrame:
    from ..operators.access import has_access

    u = F.col("user_id")
    rows = t.users.select("user_id", F.when((u % 3 == 0) | (u % 7 == 0), 100.0).alias("verified_ts"), F.when(u % 3 == 0, 900.0).alias("checked_ts"))
    m = settings.memberships(rows)
    return m.select("user_id", has_access(F.col("verified_ts"), F.col("checked_ts"), F.lit(1000.0), F.when(u % 5 == 0, False)).alias("inside"))


@query("OP-056 OP-303", "SELECT event_id FROM events WHERE event_id % 3 > 0 AND epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-05') - 1800000000")
def live_tokens(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("consumed"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_ts"))
    return settings.live_tokens(rows, F.unix_micros(F.to_timestamp(F.lit("2024-01-05"))) / 1e6).select("event_id")


@query("OP-296 OP-295", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def stored_states(t: Tables) -> DataFrame:
    raw = t.events.select(F.col("event_id").alias("user_id"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 4 == 0, "{oops").otherwise(F.col("props")).alias("data_json"))
    return settings.states(raw).select(F.col("user_id").alias("event_id"), F.col("data")["k"].alias("k"))


@query("OP-067", "SELECT e.event_id AS poll_id, e.session_id, s.quiz_id, s.chat_id, s.status AS session_status FROM group_events e JOIN group_sessions s ON s.id = e.session_id")
def group_polls(t: Tables) -> DataFrame:
    return settings.polls_with_sessions(t.group_events.select(F.col("event_id").alias("poll_id"), "session_id"), t.group_sessions)


@query("OP-128 OP-129 OP-130 OP-257 OP-258 OP-393", """
    SELECT p_partkey // 8 AS page, string_agg(p_name || ' ' || p_partkey, '|' ORDER BY (p_partkey % 8) // 2, p_partkey % 2) AS text FROM part GROUP BY 1""")
def page_rows(t: Tables) -> DataFrame:
    """Eight pieces a page, two on each row, given in disorder: no column has a question, so rows are read across."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [L.Piece(300.0 * (k % 2) + 20, 20.0 * (k % 8 // 2), 300.0 * (k % 2) + 200, 20.0 * (k % 8 // 2) + 10 + k % 3, f"{n} {k}") for k, n in zip(rows.p_partkey, rows.p_name, strict=True)]
        ordered, _ = L.in_order(pieces[::-1], 600)
        return pd.DataFrame({"page": [rows.page.iloc[0]], "text": ["|".join(p.text for p in ordered)]})

    found = t.part.select(F.expr("p_partkey div 8").alias("page"), "p_partkey", "p_name").groupBy("page").applyInPandas(work, "page long, text string")
    return found.select("page", F.regexp_replace("text", r"(\d) (?=\D)", "$1|").alias("text"))


@query("OP-198 OP-349 OP-178 OP-179", """
    WITH q AS (SELECT *, substr('ABCD', correct_index + 1, 1) AS letter FROM questions)
    SELECT id, '<span class="formula inline" data-source="x^2">x<sup>2</sup></span> &amp; ' || question AS html,
           CASE WHEN correct_index = position % 4 THEN '✅ <b>सही उत्तर!</b> ' ELSE '❌ <b>गलत उत्तर!</b> (आपका चुनाव: ' || substr('ABCD', position % 4 + 1, 1) || ')' || chr(10) || '✔️ <b>सही उत्तर:</b> ' END || '(' || letter || ') ' || lower(letter) AS feedback
    FROM q""")
def rendered_questions(t: Tables) -> DataFrame:
    """Questions as HTML and feedback, rendered in batches."""

    @F.pandas_udf("string")
    def rich(text: pd.Series) -> pd.Series:
        return text.map(R.rich_text)

    @F.pandas_udf("string")
    def told(correct: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([R.feedback(["a", "b", "c", "d"], int(c), "correct" if c == p % 4 else "wrong", int(p) % 4) for c, p in zip(correct, place, strict=True)])

    return t.questions.select("id", rich(F.concat(F.lit("$x^2$ & "), "question")).alias("html"), told("correct_index", "position").alias("feedback"))
