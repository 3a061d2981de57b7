"""Tables, reports, sessions, snapshots and the attempt machine on small cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import ranking, reports, sessions, snapshot, stats, tables
from tallyforge.streaming import queries as Q
from tallyforge.streaming import stateful as S
from tallyforge.streaming.machine import EXPIRY_US, Attempt, export_times


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ATTEMPTS = "id long, user_id long, quiz_id string, status string, total long, correct long, wrong long, skipped long, timeouts long, negative_mark double, duration_sec double, finished_at timestamp"


@pytest.fixture(scope="module")
def attempts(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([
        (1, 1, "q", "finished", 4, 3, 1, 0, 0, 0.5, 50.0, t), (2, 1, "q", "finished", 4, 3, 1, 0, 0, 0.5, 40.0, t), (3, 2, "q", "finished", 4, 3, 1, 0, 0, 0.5, 40.0, t),
        (4, 3, "q", "stopped", 4, 4, 0, 0, 0, None, 9.0, t), (5, 4, "q", "active", 4, 4, 0, 0, 0, None, 1.0, t), (6, 5, "q", "finished", 0, 0, 0, 0, 0, None, 0.0, t), (7, 3, "q", "expired", 4, 4, 0, 0, 0, None, 9.0, t),
    ], ATTEMPTS)


def test_rank_and_leaders(spark, attempts):
    users = spark.createDataFrame([(1, "a", None)], "user_id long, username string, first_name string")
    assert [(r["user_id"], r["rank"], r["participants"]) for r in stats.ranks(attempts).orderBy("rank").collect()] == [(1, 1, 3), (2, 2, 3), (5, 3, 3)]
    assert [r["user_id"] for r in stats.leaders(attempts, users).orderBy("place").collect()] == [3, 1, 2, 5]
    s = stats.quiz_stats(attempts).first()
    assert (s["attempts"], s["users"], s["avg_pct"]) == (5, 4, 81.25)
    assert stats.quiz_stats(attempts.limit(0)).count() == 0


def test_answer_that_counts(spark):
    rows = spark.createDataFrame([(1, 7, 1, None, "skipped"), (2, 7, 1, 2, "wrong"), (3, 7, 1, None, "timeout"), (4, 7, 1, 3, "wrong"), (5, 8, 1, None, "skipped"), (6, 8, 1, None, "timeout")], "id long, question_id long, attempt_id long, chosen_index int, status string")
    got = {r["question_id"]: r["a"]["id"] for r in reports.index_answers(rows, "attempt_id", "question_id").collect()}
    assert got == {7: 4, 8: 5}


def test_report_rules(spark):
    papers = spark.createDataFrame([(1, 0, 10, 2), (1, 1, 11, None), (1, 2, 12, 1), (1, 3, 13, 0)], "attempt_id long, idx int, question_id long, correct_index int")
    answers = spark.createDataFrame([(1, 1, 10, 0, 2, 0, "wrong"), (2, 1, 11, 1, 3, 1, "correct"), (3, 1, 0, 2, 3, 1, "correct"), (4, 1, 13, 3, None, 0, "timeout")], "id long, attempt_id long, question_id long, position int, chosen_index int, correct int, status string")
    got = {r["idx"]: (r["status"], r["chosen"], r["skipped"]) for r in reports.attempt_report(papers, answers).collect()}
    assert got == {0: ("correct", 2, False), 1: ("correct", 3, False), 2: ("wrong", 3, False), 3: ("unanswered", None, True)}
    marks = spark.createDataFrame([(1, 0.25)], "attempt_id long, negative_mark double")
    t = reports.report_totals(reports.attempt_report(papers, answers), marks, "attempt_id").first()
    assert (t["total"], t["correct"], t["incorrect"], t["net"], t["consistent"]) == (4, 2, 1, 1.75, True)


def test_breakdown_needs_a_named_section(spark):
    papers = spark.createDataFrame([(1, 10, " "), (1, 11, "A"), (2, 10, None), (2, 11, "")], "attempt_id long, question_id long, section string")
    answers = spark.createDataFrame([(1, 1, 10, "correct", 1), (2, 1, 10, "wrong", 0)], "id long, attempt_id long, question_id long, status string, correct int")
    got = reports.section_breakdown(papers, answers, spark.createDataFrame([(1, 0.5)], "attempt_id long, negative_mark double"))
    assert rows_of(got) == [(1, "A", 1, 0, 0, 1, 0.0), (1, "General", 1, 0, 1, 0, -0.5)]


OLD = "k int, a string, b int"


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "x", 1), (2, "y", None)], OLD), spark.createDataFrame([(2, None, 5), (3, "z", 6)], OLD)
    assert rows_of(tables.upsert(old, new, ["k"])) == [(1, "x", 1), (2, None, 5), (3, "z", 6)]
    assert rows_of(tables.upsert(old, new, ["k"], {"b": F.col("n.b")})) == [(1, "x", 1), (2, "y", 5), (3, "z", 6)]
    assert rows_of(tables.upsert(old, new, ["k"], where=F.col("n.b") > 9)) == [(1, "x", 1), (2, "y", None), (3, "z", 6)]
    once = tables.upsert(old, new, ["k"])
    assert rows_of(tables.upsert(once, new, ["k"])) == rows_of(once)
    assert rows_of(tables.restore_plan(once, new, ["k"])) == [("live only", 1), ("unchanged", 2)]
    assert rows_of(tables.insert_missing(old, new, ["k"])) == [(1, "x", 1), (2, "y", None), (3, "z", 6)] and rows_of(tables.delete(old, new, ["k"])) == [(1, "x", 1)]
    wanted = spark.createDataFrame([(2, None, 9), (1, 7, 9)], "k int, expected int, value int")
    assert rows_of(tables.swapped(old, wanted, ["k"], "b")) == [(1, "x", 1, False), (2, "y", 9, True)]


def test_evolve_and_visible(spark):
    df = spark.createDataFrame([(1, ("t", 2))], "id int, s struct<Token: string, x: int>").withColumn("api_key", F.lit("k"))
    assert tables.visible(df).schema.simpleString() == "struct<id:int,s:struct<x:int>>"
    got = tables.evolve(df, T.StructType.fromDDL("id long, mark double, n int"), {"mark": 0.5})
    assert got.columns == ["id", "mark", "n", "s", "api_key"] and got.first()[:3] == (1, 0.5, None)
    assert tables.lost_columns(["ID"], df) == ["s", "api_key"]


def test_moves_and_appends(spark):
    q = spark.createDataFrame([(i, "q", i * 10, f"t{i}") for i in (1, 2, 3)], "id int, quiz_id string, position int, question string")
    move = lambda i, d: [r["id"] for r in tables.moved(q, spark.createDataFrame([(i, d)], "id int, delta int")).orderBy("position").collect()]
    assert move(2, -1) == [2, 1, 3] and move(2, 5) == [1, 3, 2] and move(1, -1) == [1, 2, 3] and move(9, 1) == [1, 2, 3]
    assert [r["position"] for r in tables.without_questions(q, q.where("id = 2")).orderBy("id").collect()] == [1, 2]
    new = spark.createDataFrame([("q", 1, "n"), ("q", 2, "m"), ("z", 1, "o")], "quiz_id string, n int, question string")
    assert rows_of(tables.appended(q, new, 4)) == [("q", 1, "n", 31, True), ("q", 2, "m", 32, True), ("z", 1, "o", 1, False)]


def test_claims(spark):
    ledger = spark.createDataFrame([("a", 1, "s", 1, "sent"), ("b", 2, "s", 1, "failed")], "event_key string, user_id int, sha256 string, target int, status string")
    events = spark.createDataFrame([("a", 9, "z", 1, 1), ("c", 1, "s", 1, 2), ("d", 2, "s", 1, 3), ("e", 2, "s", 1, 4), ("f", 3, "s", 1, 5), ("f", 4, "s", 1, 6)], "event_key string, user_id int, sha256 string, target int, at int")
    assert sorted(r["event_key"] for r in tables.claims(ledger, events).collect()) == ["d", "f"]


def test_streaks_pauses_gaps(spark):
    a = spark.createDataFrame([(1, i, s) for i, s in enumerate(["skipped"] * 11 + ["correct"] + ["timeout"] * 4)], "u int, i int, status string")
    assert rows_of(sessions.miss_streaks(a, "u", "i")) == [(1, 11, 1, 11), (1, 4, 13, 16)] and rows_of(sessions.auto_pauses(a, "u", "i")) == [(1, 2)]
    t = datetime(2024, 1, 1)
    c = spark.createDataFrame([(1, t + timedelta(seconds=s), i, k) for i, (s, k) in enumerate([(0, "resume"), (1, "pause"), (3, "pause"), (6, "resume"), (7, "resume"), (9, "pause")])], "u int, ts timestamp, id int, kind string")
    assert rows_of(sessions.pauses(c, "u")) == [(1, 1, 5_000_000)]
    n = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 5), ("s", 4, 5)], "s string, pos int, number int")
    assert rows_of(sessions.number_gaps(n, "s")) == [("s", 3), ("s", 4)]


def test_snapshots(spark):
    parents, children = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("z", 1, 30)], "quiz_id string, position int, id int")
    nested = snapshot.nest(parents, children, "id", "quiz_id", "questions", "position")
    assert {r["id"]: [c["id"] for c in r["questions"]] for r in nested.collect()} == {"a": [10, 20], "b": []}
    assert rows_of(snapshot.unnest(nested, "questions").select("id")) == [(10,), (20,)] and rows_of(snapshot.orphans(children, parents, "quiz_id").select("id")) == [(30,)]
    kept = snapshot.redact(spark.createDataFrame([(1, "n", 2)], "user_id int, username string, x int"))
    assert kept.first()[:] == (None, None, 2, True) and snapshot.redact(kept.drop("redacted"), drop=True).columns == ["x", "redacted"]
    many = spark.range(25).select(F.lit("a").alias("quiz_id"), (24 - F.col("id")).alias("position"), F.col("id").alias("id"))
    nested = snapshot.nest(parents, many, "id", "quiz_id", "questions", "position", size=10)
    assert rows_of(nested.select("id", "chunk", F.transform("questions", lambda x: x["id"]))) == [("a", 0, list(range(24, 14, -1))), ("a", 1, list(range(14, 4, -1))), ("a", 2, [4, 3, 2, 1, 0]), ("b", 0, [])]
    assert rows_of(snapshot.unnest(nested, "questions", "id").toDF("quiz_id", "position", "id")) == rows_of(many)
    none = spark.createDataFrame([], "quiz_id string, id long")
    assert rows_of(snapshot.missing_inventory(parents.where("id = 'a'"), spark.range(5).select(F.lit("b").alias("quiz_id"), "id"), none, 3)) == [("b", "attempt", 0, [0, 1, 2]), ("b", "attempt", 1, [3, 4])]
    users = spark.range(50).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("x"))
    assert {r["user_ref"]: r["x"] for r in snapshot.user_refs(users).collect()} == {f"u{i}": 2 * i for i in range(50)}
    assert snapshot.content_hash(parents.limit(0)).first()[:] == (0, "0")
    assert spark.range(1).select(snapshot.secret_fields(F.lit('{"password": 1, "x": "abc"}'), ["abc", "zz"])).first()[0] == ["secret 0", "field password"]


def test_machine():
    a = Attempt()
    assert a.apply("sent", 100, "p") and not a.apply("answer", 110, "other", True) and a.apply("answer", 130, "p", True) and not a.apply("answer", 140, "p", True)
    assert a.out[-1]["elapsed_us"] == 30 and (a.correct, a.index, a.streak) == (1, 1, 0)
    for i in range(5):
        assert a.apply("sent", 200 + i, f"q{i}") and a.apply("timeout", 210 + i, f"q{i}")
    assert a.status == "paused" and (a.skipped, a.timeouts) == (5, 5) and not a.apply("sent", 300, "r") and not a.apply("pause", 300)
    assert a.apply("resume", 314) and a.paused_total == 100 and a.apply("sent", 320, "r") and a.apply("pause", 330) and not a.apply("answer", 331, "r", True) and a.apply("resume", 400) and a.apply("answer", 405, "r", False)
    assert a.out[-1] | {"status": "wrong", "elapsed_us": 15} == a.out[-1]
    assert a.apply("finish", 500) and a.out[-1]["elapsed_us"] == 500 - 100 - 170 and not a.apply("finish", 501)
    assert a.apply("restart", 600) and (a.run, a.correct, a.status) == (1, 0, "active")
    b = Attempt()
    b.apply("sent", 1, "p")
    assert not b.apply("answer", EXPIRY_US + 2, "p", True) and b.status == "expired" and b.out[-1]["kind"] == "expired"


def test_export_times():
    assert export_times([]) == [] and export_times([0, 1, 2]) == [7] and export_times([0, 10]) == [5, 35]
    steady = export_times([float(i) for i in range(0, 300, 2)])
    assert steady[0] == 120 and all(b - a >= 30 for a, b in zip(steady, steady[1:], strict=False))


def events_of(seed=1, n=300):
    rng, t = random.Random(seed), datetime(2024, 1, 1)
    kinds = ["sent", "sent", "answer", "answer", "timeout", "skip", "pause", "resume", "finish", "restart"]
    return [(rng.randint(1, 5), t + timedelta(seconds=i), rng.choice(kinds), rng.choice("pq"), rng.random() < 0.5, i) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    schema, rows = "attempt_id long, at timestamp, kind string, poll string, correct boolean, event_id long", events_of()
    for i in range(3):  # files arrive one after the other
        spark.createDataFrame(rows[100 * i : 100 * i + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = rows_of(Q.drained(S.run_attempts(stream), "t"))
    want = []
    for attempt in {r[0] for r in rows}:
        a = Attempt()
        for r in sorted((r for r in rows if r[0] == attempt), key=lambda r: (r[1], r[5])):
            a.apply(r[2], int((r[1] - datetime(1970, 1, 1)).total_seconds() * 1e6), r[3], r[4])
        want += [(attempt, o["ts"], o["kind"], o["index"], o["run"], o["status"], o["elapsed_us"]) for o in a.out]
    got_set, want_set = set(got), set(want)
    assert want_set <= got_set and all(g[2] == "expired" for g in got_set - want_set)


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 5.0, 5.25, 30.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x double, s double").repartition(5)
    order = [F.desc("x"), F.asc("s"), F.asc("id")]
    got = {r["id"]: (r["place"], r["n"]) for r in ranking.numbered(df, ["g"], order, total="n", parts=7).collect()}
    w = Window.partitionBy("g")
    want = {r["id"]: (r["p"], r["n"]) for r in df.withColumn("p", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w)).collect()}
    assert got == want
    assert not ranking.numbered(df.limit(0), ["g"], order, total="n").collect()


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("case", ["equal scores", "sparse ids", "clusters"])
def test_numbered_evenly(spark, case, by):
    """All scores equal in one group, or ids far apart: no range has more than a twentieth of the rows, and numbers have no gap."""
    n = 40_000
    ids = {"equal scores": F.col("id"), "sparse ids": F.xxhash64("id"), "clusters": F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 2**60)}[case]
    df = spark.range(0, n, 1, 8).select(F.lit("g").alias("g"), F.lit(1.0).alias("score"), ids.alias("id"))
    placed = ranking.numbered(df, by, [F.desc("score"), F.asc("id")], parts=40)
    assert rows_of(placed.agg(F.min("place"), F.max("place"), F.countDistinct("place"), F.count(F.lit(1)))) == [(1, n, n, n)]
    assert placed.withColumn("before", F.lag("id").over(Window.orderBy("place"))).where("id <= before").isEmpty()
    dealt = [p for p in placed.inputFiles()]
    sizes = [spark.read.parquet(p).count() for p in dealt]
    assert sum(sizes) == n and max(sizes) <= n / 20



def test_texts_of_odd_rows(spark):
    """A deleted quiz, markup in names, nothing answered, no attempt at all."""
    from tallyforge.operators import lookups, summaries

    t = datetime(2024, 1, 1)
    attempts = spark.createDataFrame([(1, 1, "gone", "stopped", 4, 0, 0, 1, 1, 1 / 3, 61.0, t), (2, 2, "<q>", "finished", 0, 0, 0, 0, 0, None, 0.0, None)], ATTEMPTS)
    quizzes = spark.createDataFrame([("<q>", 1, "A & <B>"), ("empty", 1, "E")], "id string, owner_id long, title string")
    users = spark.createDataFrame([(2, None, "<x>")], "user_id long, username string, first_name string")
    told = {r["id"]: r["text"] for r in summaries.result_texts(attempts, quizzes).collect()}
    assert "Quiz stopped" in told[1] and "Not attempted: 3" in told[1] and "-1/3" in told[1] and "Timeout: 1 ⏰ (Skipped में शामिल)" in told[1] and "Quiz: A &amp; &lt;B&gt;" in told[2] and "rank" not in told[2]
    over = {r["user_id"]: r["text"] for r in summaries.user_overviews(attempts, quizzes).collect()}
    assert "• Deleted quiz: 0/4 (0.0%)" in over[1] and over[2].endswith("• A &amp; &lt;B&gt;: 0/0 (0%) • ")
    sessions = spark.createDataFrame([], "id long, quiz_id string, chat_id long, status string")
    group = spark.createDataFrame([], "session_id long, user_id long")
    owner = {r["quiz_id"]: r["text"] for r in summaries.owner_texts(quizzes, attempts, users, sessions, group).collect()}
    assert "🥇 &lt;x&gt; — 0/0 (0%)" in owner["<q>"] and owner["empty"].endswith("Average score: 0.0%")
    seen = {(r["quiz_id"], r["user_id"]): r["text"] for r in summaries.own_texts(quizzes, attempts, spark.createDataFrame([("<q>", 1), ("<q>", 2), ("empty", 9)], "quiz_id string, user_id long")).collect()}
    assert set(seen) == {("<q>", 2), ("empty", 9)} and "1 / 1" in seen["<q>", 2] and "पूरा नहीं" in seen["empty", 9]
    asked = spark.createDataFrame([(2,), (2,), (0,), (None,), (7,)], "user_id long")
    assert [r["user_id"] for r in lookups.looked_up(users, asked, "user_id").collect()] == [2]
    stored = spark.createDataFrame([(1, "active", None, " ", None), (2, "active", "[3, 1]", "[0]", "p"), (3, "finished", "broken", None, "p")], "id long, status string, order_json string, cur_perm_json string, cur_poll_id string")
    assert rows_of(lookups.decoded_attempts(stored).select("id", "order", "cur_perm")) == [(1, [], None), (2, [3, 1], [0]), (3, [], None)]
    assert [r["id"] for r in lookups.attempts_by_poll(stored, spark.createDataFrame([("p",), ("p",), (None,)], "poll_id string")).collect()] == [2]


def test_status_text(spark):
    from tallyforge.operators import summaries

    counts, none = spark.createDataFrame([("b", 2), ("a", 1)], "name string, rows long"), spark.createDataFrame([], "rule string, record string")
    assert summaries.status_text(counts, none).first()[0].split("\n")[1:] == ["Records: a=1, b=2", "Integrity: ✅ valid"]
    bad = spark.createDataFrame([(r, "x") for r in "wxxyyyzzzz"], "rule string, record string")
    assert summaries.status_text(counts, bad).first()[0].endswith("Integrity: ❌ z: 4; y: 3; x: 2")
