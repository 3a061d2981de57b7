"""Streams over the driver's events, drained into tables; and what Spark adds beyond the inventory (ext_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import buckets
from ..shared import fresh_dir
from ..streaming import queries as Q
from ..streaming import stateful as S
from .registry import query


@query("OP-311 OP-309", "SELECT session_id, user_id, question_id, event_id, answered_ts FROM group_answers")
def stream_group_answers(t: Tables) -> DataFrame:
    e = Q.stream_table(t.spark, t.sf_dir, "events")
    day = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("long")
    events = e.select(day.alias("session_id"), "user_id", F.col("event_type").alias("question_id"), "event_id", F.col("ts").cast("timestamp").alias("answered_ts"))
    return Q.drained(S.accepted_group_answers(events), "answers")


_EXPIRY = 24 * 3_600_000_000
_ROW = lambda kind, index, run, status="''", elapsed="0": f"{{'kind': {kind}, 'index': {index}::BIGINT, 'run': {run}::BIGINT, 'status': {status}, 'elapsed_us': {elapsed}::BIGINT}}"


@query("OP-308 OP-312 OP-315 OP-316 OP-319 OP-320 OP-321 OP-322 OP-323 OP-326 OP-328 OP-314", f"""
    WITH RECURSIVE e AS (
        SELECT user_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
               CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'wrong' WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'skipped' ELSE 'restart' END AS k FROM events),
    r AS (
        SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS ts, 'active' AS state, false AS live, 0::BIGINT AS sent, 0::BIGINT AS place, 0::BIGINT AS streak, 0::BIGINT AS started, 0::BIGINT AS paused_at, 0::BIGINT AS run,
               [{_ROW("'none'", 0, 0)}] AS told FROM events
        UNION ALL
        SELECT user_id, n, ts, CASE WHEN again THEN 'active' WHEN late THEN 'expired' WHEN recorded AND missed >= 5 THEN 'paused' ELSE state END,
               CASE WHEN again OR recorded THEN false WHEN asked THEN true ELSE live END, CASE WHEN again OR recorded THEN 0 WHEN asked THEN ts ELSE sent END, CASE WHEN again THEN 0 WHEN recorded THEN place + 1 ELSE place END,
               CASE WHEN again OR (recorded AND missed >= 5) THEN 0 WHEN recorded THEN missed ELSE streak END, CASE WHEN again THEN 0 WHEN asked AND started = 0 THEN ts ELSE started END,
               CASE WHEN again THEN 0 WHEN recorded AND missed >= 5 THEN ts ELSE paused_at END, CASE WHEN again THEN run + 1 ELSE run END,
               CASE WHEN again AND state <> 'expired' THEN [{_ROW("'finished'", "place", "run", elapsed="CASE WHEN started > 0 THEN greatest(0, ts - started - paused) ELSE 0 END")}, {_ROW("'restart'", 0, "run + 1")}]
                    WHEN again THEN [{_ROW("'restart'", 0, "run + 1")}] WHEN late THEN [{_ROW("'expired'", "place", "run")}]
                    WHEN recorded AND missed >= 5 THEN [{_ROW("'answer'", "place", "run", "k", "took")}, {_ROW("'pause'", "place + 1", "run")}] WHEN recorded THEN [{_ROW("'answer'", "place", "run", "k", "took")}] ELSE [] END
        FROM (SELECT *, state = 'active' AND NOT late AND k = 'sent' AS asked, state = 'active' AND NOT late AND ((k IN ('correct', 'wrong') AND live) OR k = 'skipped') AS recorded,
                     CASE WHEN k <> 'skipped' THEN 0 ELSE streak + live::INT END AS missed, CASE WHEN live THEN greatest(0, ts - sent) ELSE 0 END AS took
              FROM (SELECT *, k = 'restart' AS again, k <> 'restart' AND state <> 'expired' AND started > 0 AND ts - started - paused > {_EXPIRY} AS late
                    FROM (SELECT r.* EXCLUDE (n, ts, told), e.n, e.ts, e.k, CASE WHEN state = 'paused' THEN greatest(0, e.ts - paused_at) ELSE 0 END AS paused FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x) y) z
    ),
    t AS (SELECT user_id, ts, unnest(told) AS x FROM r WHERE n > 0)
    SELECT user_id AS attempt_id, ts, x.kind, x.index, x.run, x.status, x.elapsed_us FROM t
    UNION ALL SELECT user_id, started + {_EXPIRY} + 1, 'expired', place, run, '', 0 FROM r
        WHERE state = 'active' AND started > 0 AND n = (SELECT max(n) FROM e WHERE e.user_id = r.user_id) AND (started + {_EXPIRY}) // 1000 + 1 <= (SELECT max(ts) FROM e) // 1000 - 3600000""")
def stream_attempts(t: Tables) -> DataFrame:
    """Each user's events as one attempt: asked, answered, skipped and begun anew, paused after five misses, expired after a day."""
    e = Q.stream_table(t.spark, t.sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "sent").when(F.col("event_type").isin("click", "purchase"), "answer").when(F.col("event_type") == "signup", "skip").otherwise("restart")
    events = e.select(F.col("user_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.lit("p").alias("poll"), (F.col("event_type") == "purchase").alias("correct"), "event_id")
    return Q.drained(S.run_attempts(events), "attempts")


@query("OP-307 OP-333 OP-334", "SELECT DISTINCT event_id, event_type FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    e = Q.stream_table(t.spark, t.sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return Q.drained(Q.first_per_key(e, ["event_id"], "ts"), "distinct").select("event_id", "event_type")


@query("OP-310", """
    SELECT event_id, poll_id, ts FROM (SELECT event_id, strftime(ts, '%Y-%m-%d ') || event_type AS poll_id, ts FROM events) a
    WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id % 97 = 0 AND strftime(c.ts, '%Y-%m-%d ') || c.event_type = a.poll_id AND c.ts <= a.ts)""")
def stream_answers_in_time(t: Tables) -> DataFrame:
    """Answers to each day's poll of a kind; every 97th event shuts its poll, itself included."""
    beats = Q.beat(t.events, "ts", "ts").withColumn("poll_id", F.lit(""))  # a poll of its own: rows without a poll would be left out before they count as time
    e = Q.stream_table(t.spark, t.sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd "), "event_type").alias("poll_id"), F.col("ts").cast("timestamp").alias("ts"))
    shut = Q.with_beat(e, beats).where("event_id IS NULL OR event_id % 97 = 0").select("poll_id", F.col("ts").alias("closed_at"))
    kept = Q.drained(Q.answers_in_time(Q.with_beat(e, beats), shut), "in_time")
    return kept.where("event_id IS NOT NULL").select("event_id", "poll_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


_HOUR = 3_600_000_000
_DUE = f"greatest(least(r.last + {6 * _HOUR}, r.first + {72 * _HOUR}), coalesce(r.before + {24 * _HOUR}, 0))"


@query("OP-332 OP-374 OP-375 OP-027", f"""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events),
    r AS (
        SELECT user_id, n, c, t AS first, t AS last, NULL::BIGINT AS before, NULL::BIGINT AS told FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, n, c, CASE WHEN due <= t THEN t ELSE first END, t, CASE WHEN due <= t THEN due ELSE before END, CASE WHEN due <= t THEN due END
        FROM (SELECT e.user_id, e.n, e.c, e.t, r.first, r.before, {_DUE} AS due FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x
    )
    SELECT user_id, told / 1e6 AS at FROM r WHERE told IS NOT NULL UNION ALL SELECT user_id, {_DUE} / 1e6 FROM r WHERE n = c""")
def export_schedule(t: Tables) -> DataFrame:
    """When each user's changes would be written out, in seconds since the epoch: six hours after the last, a day after the time before, three days after the first at the latest."""
    e = Q.stream_table(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    times = Q.drained(S.export_times(Q.with_beat(e, Q.beat(t.events, "ts", "at")), 6 * 3600, 24 * 3600, 72 * 3600), "exports")
    return times.where("key IS NOT NULL").select(F.col("key").alias("user_id"), (F.col("at_us") / 1e6).alias("at"))


@query("OP-028", """
    SELECT 'current' AS version, n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'previous', n_nationkey, n_name FROM nation""")
def versioned_copies(t: Tables) -> DataFrame:
    """A table written three times: the last version and the one before it are there, the first is gone."""
    folder = fresh_dir(t.spark, "versions")
    plain = t.nation.select("n_nationkey", "n_name")
    for version, df in enumerate((plain.limit(0), plain, plain.where("n_nationkey <> 3").withColumn("n_name", F.upper("n_name")))):
        Q.publish(df, folder, version)
    if Q.is_written(t.spark, f"{folder}/v0"):
        raise ValueError("an old version was kept")
    named = [t.spark.read.parquet(f"{folder}/v{v}").select(F.lit(name).alias("version"), "n_nationkey", "n_name") for name, v in (("current", 2), ("previous", 1))]
    return named[0].unionByName(named[1])


@query("OP-307 OP-334 OP-034", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_upserted(t: Tables) -> DataFrame:
    """The last event of each user, merged batch by batch into a table of buckets."""
    e = Q.stream_table(t.spark, t.sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return Q.merged_into(e, fresh_dir(t.spark, "upserted"), ["user_id"], ["ts", "event_id"])


@query("OP-028 OP-334", """
    SELECT 'current' AS version, o_orderkey, CASE WHEN o_custkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
    UNION ALL SELECT 'current', -1, 'N' UNION ALL SELECT 'previous', o_orderkey, o_orderstatus FROM orders""")
def bucketed_versions(t: Tables) -> DataFrame:
    """A table of orders, and one merge of some changed rows and a new one: the last version and the one before it."""
    folder, plain = fresh_dir(t.spark, "orders"), t.orders.select("o_orderkey", "o_orderstatus")
    buckets.merge(plain, folder, 0, ["o_orderkey"])
    changed = t.orders.where("o_custkey = 7").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    buckets.merge(changed.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))), folder, 1, ["o_orderkey"])
    named = [buckets.read(t.spark, folder, v).select(F.lit(name).alias("version"), "o_orderkey", "o_orderstatus") for name, v in (("current", 1), ("previous", 0))]
    return named[0].unionByName(named[1])


# ----------------------------------------------------------- extensions


@query("ext", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority)::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").cast("long").alias("g"))


@query("ext", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling_windows(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("ext", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def ext_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("ext", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def ext_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("ext", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rank FROM orders")
def ext_analytic_windows(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.ntile(4).over(w.orderBy("o_orderkey")).alias("quarter"), F.dense_rank().over(w.orderBy("o_orderdate")).alias("rank"))


@query("ext", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def ext_pivot(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return out.select("o_custkey", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])
