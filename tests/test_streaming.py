"""Stateful streams: batches against one run, stops and restarts, odd keys, timers, late answers."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.streaming import queries as Q
from tallyforge.streaming import stateful as S
from tallyforge.streaming.machine import EXPIRY_US, Schedule, export_times

START = datetime(2024, 1, 1)
EVENTS = "session_id long, user_id long, question_id string, event_id long, answered_ts timestamp"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def arriving(spark, folder, schema, parts):
    """A stream of files, one a batch; each part is a file."""
    for i, rows in enumerate(parts):
        if rows is not None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def answers(n=400, seed=1):
    rng, at = random.Random(seed), START
    out = []
    for i in range(n):
        at += timedelta(seconds=rng.randint(0, 20))
        out.append((rng.choice([1, 1, 1, 2, None]), rng.choice([None, -1, 0, 7, 2**62]), rng.choice(["a", "b\nc", "", None, "é", "a\n"]), i, at if rng.random() < 0.97 else None))
    return out


def first_of(batches):
    """What passes: of a batch's answers to one question the earliest, unless an earlier batch had one."""
    seen, out = set(), []
    for rows in batches:
        for r in sorted((r for r in rows if r[4] is not None), key=lambda r: (r[4], r[3])):
            if r[:3] not in seen:
                seen.add(r[:3])
                out.append(r)
    return sorted(out, key=str)


def test_first_answers_over_restarts(spark, tmp_path):
    """Three files, then a stop, then two more from the checkpoint: as if all had come in one run. Keys may be null or hold line breaks."""
    rows = answers()
    parts = [rows[80 * i : 80 * i + 80] for i in range(5)]
    folder, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    stream = arriving(spark, folder, EVENTS, parts[:3])
    assert rows_of(Q.drained(S.accepted_group_answers(stream, lanes=3), "a", kept)) == first_of(parts[:3])
    stream = arriving(spark, folder, EVENTS, [None] * 3 + parts[3:])
    assert rows_of(Q.drained(S.accepted_group_answers(stream, lanes=3), "a", kept)) == first_of(parts)


def test_first_answers_are_forgotten(spark, tmp_path):
    """Once the watermark is long past a session, its state is gone and an answer that comes again passes again."""
    one = (1, 1, "q", 1, START)
    far = (9, 9, "q", 2, START + timedelta(days=9))
    parts = [[one], [far], [(9, 9, "r", 3, START + timedelta(days=9, hours=1))], [(1, 1, "q", 4, START + timedelta(days=9))]]
    got = rows_of(Q.drained(S.accepted_group_answers(arriving(spark, str(tmp_path), EVENTS, parts), "1 hour"), "a"))
    assert [r[3] for r in got] == [1, 4, 2, 3]


class CountedState:
    """A state variable in memory, with the number of calls that it got."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._call(bool(self.held))

    def containsKey(self, key):
        return self._call(key in self.held)

    def getValue(self, key):
        return self._call(self.held.get(key))

    def get(self):
        return self._call(self.held.get(()))

    def updateValue(self, key, value):
        self._call(self.held.update({key: value}))

    def update(self, value):
        self._call(self.held.update({(): value}))


def test_first_answers_call_the_state_by_parts():
    """However many answers a lane gets at once, the state store gets a bounded number of calls; each is a message to another process."""
    states = {"seen": CountedState(), "last": CountedState()}
    handle = SimpleNamespace(getMapState=lambda name, *_: states[name], getValueState=lambda name, *_: states[name], registerTimer=lambda _: None, deleteTimer=lambda _: None)
    machine, clock = S.FirstAnswers(1000), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    machine.init(handle)
    told = [Row(session_id=1, user_id=i % 5000 or None, question_id="q\n" if i % 2 else None, event_id=i, answered_ts=START, at_us=i) for i in range(20_000)]
    got = [r.event_id for part in (told[:12_000], told[6_000:]) for r in machine.handleInputRows((1, 0), iter(part), clock)]
    assert sorted(got) == list(range(5000))
    assert states["seen"].calls < 500


ATTEMPT = "attempt_id long, at timestamp, kind string, poll string, correct boolean, event_id long"


def test_attempts_expire_and_odd_events(spark, tmp_path):
    parts = [
        [(1, START, "sent", "p", None, 1), (None, START, "sent", None, None, 2), (None, START, "skip", None, None, None), (1, None, "answer", "p", True, 3), (1, START, None, "p", True, 4), (1, START, "nonsense", "p", True, 5)],
        [(2, START + timedelta(days=3), "sent", "p", None, 6)],
    ]
    got = rows_of(Q.drained(S.run_attempts(arriving(spark, str(tmp_path), ATTEMPT, parts)), "t"))
    start = int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert [(r[0], r[1] - start, r[2], r[5]) for r in got] == [(1, EXPIRY_US + 1, "expired", ""), (None, 0, "answer", "skipped"), (None, EXPIRY_US + 1, "expired", "")]


def test_attempts_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["sent", "sent", "answer", "answer", "timeout", "skip", "pause", "resume", "finish", "restart"]
    rows = [(rng.randint(1, 4), START + timedelta(seconds=i), rng.choice(kinds), rng.choice("pq"), rng.random() < 0.5, i) for i in range(240)]
    parts = [rows[60 * i : 60 * i + 60] for i in range(4)]
    once = rows_of(Q.drained(S.run_attempts(arriving(spark, str(tmp_path / "one"), ATTEMPT, parts)), "t"))
    folder, kept = str(tmp_path / "two"), str(tmp_path / "kept")
    Q.drained(S.run_attempts(arriving(spark, folder, ATTEMPT, parts[:2])), "t", kept)
    assert rows_of(Q.drained(S.run_attempts(arriving(spark, folder, ATTEMPT, [None, None, *parts[2:]])), "t", kept)) == once and once


def brute_schedule(changes, debounce, least, latest):
    """Second by second."""
    out, first, last = [], None, None
    for now in range(max(changes, default=0) + latest + least + 2):
        if first is not None and now >= max(min(last + debounce, first + latest), out[-1] + least if out else 0):
            out.append(now)
            first = None
        for _ in (c for c in changes if c == now):
            first, last = now if first is None else first, now
    return out


def test_schedule():
    rng = random.Random(3)
    for _ in range(200):
        changes = sorted(rng.randint(0, 300) for _ in range(rng.randint(0, 25)))
        rules = rng.randint(1, 10), rng.randint(1, 40), rng.randint(10, 60)
        plan = Schedule(*(x * 10**6 for x in rules))
        got = [due // 10**6 for c in changes for due in plan.change(c * 10**6)] + [due // 10**6 for due in plan.until(10**12)]
        assert got == brute_schedule(changes, *rules)
    assert export_times([3, 1, 2]) == [8]


def test_export_times_of_a_stream(spark, tmp_path):
    """Changes out of order within the delay, over several files and a restart, and a key without a value."""
    rng = random.Random(4)
    changes = sorted(((START + timedelta(seconds=rng.randint(0, 3000)), rng.choice([1, 2, None])) for _ in range(300)), key=lambda x: x[0])
    rows = [(k, t) for t, k in changes]
    for i in range(0, 300, 10):  # ten at a time in any order
        part = rows[i : i + 10]
        rng.shuffle(part)
        rows[i : i + 10] = part
    parts = [rows[100 * i : 100 * i + 100] for i in range(3)] + [[(99, START + timedelta(days=2)), (5, None)]]
    folder, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    Q.drained(S.export_times(arriving(spark, folder, "key long, at timestamp", parts[:2]), delay="1 hour"), "x", kept)
    got = Q.drained(S.export_times(arriving(spark, folder, "key long, at timestamp", [None, None, *parts[2:]]), delay="1 hour"), "x", kept).where("key IS NULL OR key <> 99").collect()
    zero = datetime(1970, 1, 1)
    for key in (1, 2, None):
        want = export_times([(t - zero).total_seconds() for k, t in rows if k == key])
        assert sorted(r["at_us"] / 1e6 for r in got if r["key"] == key) == pytest.approx(want)


def test_answers_in_time(spark, tmp_path):
    """Before, at and after closing, without a closing, in a poll that closes twice, and closings that come later than the answers."""
    t = lambda s: START + timedelta(seconds=s)
    told = [[("p", t(5), 1), ("p", t(10), 2), ("p", t(11), 3), ("q", t(50), 4), (None, t(1), 5), ("r", None, 6), ("r", t(20), 7), ("r", t(40), 8)], [("end", t(10**6), 0)]]
    shut = [[("q", t(60))], [("p", t(10)), ("r", t(30)), ("r", t(35)), (None, t(0))], [("end", t(10**6))]]
    a = arriving(spark, str(tmp_path / "a"), "poll_id string, ts timestamp, id int", told)
    c = arriving(spark, str(tmp_path / "c"), "poll_id string, closed_at timestamp", shut)
    got = Q.drained(Q.answers_in_time(a, c), "late").where("poll_id <> 'end'").select("id").collect()
    assert sorted(r["id"] for r in got) == [1, 4, 7]


def test_beat_gives_what_waits(spark, tmp_path):
    table = spark.createDataFrame([(1, START), (1, START + timedelta(seconds=2))], "key long, at timestamp")
    stream = arriving(spark, str(tmp_path), "key long, at timestamp", [table.collect()])
    assert Q.drained(S.export_times(stream), "x").count() == 0
    stream = spark.readStream.schema("key long, at timestamp").parquet(f"{tmp_path}/*")
    assert [r["key"] for r in Q.drained(S.export_times(Q.with_beat(stream, Q.beat(table, "at", "at"))), "x").where(F.col("key").isNotNull()).collect()] == [1]


def test_answers_meet_few_closings(spark, tmp_path):
    """A poll that closes every second: an answer meets the first and the last closing of each hour."""
    t = lambda s: START + timedelta(seconds=s)
    a = arriving(spark, str(tmp_path / "a"), "poll_id string, ts timestamp, id int", [[("p", t(5), 1), ("p", t(500), 2), ("p", t(7000), 3)], [("end", t(10**6), 0)]])
    c = arriving(spark, str(tmp_path / "c"), "poll_id string, closed_at timestamp", [[("p", t(s)) for s in range(10, 400)], [("end", t(10**6))]])
    spark.conf.set(*S.STORE)
    query = Q.answers_in_time(a, c, lanes=1).writeStream.format("memory").queryName("few_closings").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if "Join" in o["operatorName"])
    assert [r["id"] for r in spark.table("few_closings").where("poll_id = 'p'").collect()] == [1]
    assert kept <= 12
