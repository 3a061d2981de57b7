"""Stateful operators over streams: first answers by map state, attempts and export times by timers of event time.

They need the RocksDB state store, which `queries.drained` sets for its query; a live query sets STORE before it starts.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .machine import ACTIVE, EXPIRY_US, FIELDS, OUTPUT, STATE, Attempt, Schedule

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Participants of a session are dealt into so many lanes, each with a state of its own.
LANES = 32
#: What is known of a lane lies in so many parts.
PARTS = 64


class FirstAnswers(StatefulProcessor):
    """Keeps who answered what in a lane of a session, and lets the first answer to each question pass.

    Answers count by time, then event id, within what has come; one that comes later never takes the place of one that
    has passed. What is known lies in PARTS parts by the hash of who and question, and a part is read and written as a
    whole: each call of the state store is a message between processes, and so many a lane are the most, not one for
    each answer. The lane's state goes once the watermark is keep_ms past its last answer.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "part int", "known string")
        self.last = handle.getValueState("last", "at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[tuple, tuple] = {}
        latest = 0
        for r in rows:
            latest = max(latest, r.at_us // 1000)
            who, told = (r.user_id, r.question_id), (r.at_us, r.event_id, r.answered_ts)
            if who not in first or told[:2] < first[who][:2]:
                first[who] = told
        parts: dict[int, list[tuple]] = defaultdict(list)
        for who in first:
            parts[zlib.crc32(repr(who).encode()) % PARTS].append(who)
        known = self.seen.exists()
        for part, those in parts.items():
            old = self.seen.getValue((part,)) if known else None
            packed = json.loads(old[0]) if old else []
            before = set(map(tuple, packed))
            new = [who for who in those if who not in before]
            if new:
                self.seen.updateValue((part,), (json.dumps(packed + new),))
            for who in new:
                _, event, at = first[who]
                yield Row(session_id=key[0], user_id=who[0], question_id=who[1], event_id=event, answered_ts=at)
        self._wait(max(latest, self.last.get()[0] if self.last.exists() else 0), timerValues)

    def _wait(self, last: int, timerValues) -> None:
        timer = max(last + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[1])
        self.handle.registerTimer(timer)
        self.last.update((last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def accepted_group_answers(events: DataFrame, delay: str = "1 day", keep_ms: int = 48 * 3_600_000, lanes: int = LANES) -> DataFrame:
    """session_id, user_id, question_id, event_id, answered_ts of answers that are the first to their question.

    A null user or question is one of its own; an answer without a time never counts. Sessions of many participants
    are spread over lanes, so a hot one is no task of its own.
    """
    told = events.select("session_id", "user_id", "question_id", "event_id", "answered_ts", F.unix_micros("answered_ts").alias("at_us")).where("answered_ts IS NOT NULL").withWatermark("answered_ts", delay)
    told = told.withColumn("lane", F.pmod(F.xxhash64("user_id"), F.lit(lanes)))
    out = "session_id long, user_id long, question_id string, event_id long, answered_ts timestamp"
    return told.groupBy("session_id", "lane").transformWithState(FirstAnswers(keep_ms), out, "append", "eventTime")


class RunningAttempts(StatefulProcessor):
    """The attempt machine of each attempt, with a timer for its expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", f"{STATE}, timer long")

    def _load(self) -> tuple[Attempt, int]:
        if not self.state.exists():
            return Attempt(), 0
        values = tuple(self.state.get())
        return Attempt(**dict(zip(FIELDS, values[:-1], strict=True))), values[-1]

    def _told(self, key, a: Attempt) -> Iterator[Row]:
        for x in a.out:
            yield Row(attempt_id=key[0], **{f: x[f] for f in ("ts", "kind", "index", "run", "status", "elapsed_us")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        a, timer = self._load()
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id is not None, r.event_id)):
            a.apply(r.kind or "", r.ts, r.poll or "", bool(r.correct))
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if a.status == ACTIVE and a.started:
            timer = max(timerValues.getCurrentWatermarkInMs() + 1, (a.started + EXPIRY_US + a.paused_total) // 1000 + 1)
            self.handle.registerTimer(timer)
        values = asdict(a)
        self.state.update((*(values[f] for f in FIELDS), timer))
        yield from self._told(key, a)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        a, _ = self._load()
        a.apply("expire", a.started + EXPIRY_US + a.paused_total + 1)
        self.state.clear()
        yield from self._told(key, a)

    def close(self) -> None:
        pass


def run_attempts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What the attempt machine tells of a stream of events (attempt_id, at, kind, poll, correct, event_id).

    An attempt whose time runs out by the watermark expires. An event without a time never counts; a null attempt is
    one of its own, and an unknown or null kind takes no effect.
    """
    timed = events.where("at IS NOT NULL").withWatermark("at", delay).withColumn("ts", F.unix_micros("at"))
    return timed.groupBy("attempt_id").transformWithState(RunningAttempts(), OUTPUT, "append", "eventTime")


class ExportTimes(StatefulProcessor):
    """When each key's changes are written out: changes wait until the watermark has passed them, then count in order."""

    def __init__(self, debounce_us: int, least_us: int, latest_us: int):
        self.rules = (debounce_us, least_us, latest_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.open = handle.getValueState("open", "first long, last long, before long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [r.at_us for r in rows]
        self.waiting.appendList([(x,) for x in new])
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, (max(new) + self.rules[0]) // 1000 + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = sorted(x[0] for x in self.waiting.get()) if self.waiting.exists() else []
        plan = Schedule(*self.rules, *(self.open.get() if self.open.exists() else ()))
        for at in (x for x in known if x <= now):
            for due in plan.change(at):
                yield Row(key=key[0], at_us=due)
        for due in plan.until(now):
            yield Row(key=key[0], at_us=due)
        later = [(x,) for x in known if x > now]
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
        self.open.update((plan.first, plan.last, plan.before))
        if plan.first is not None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, -(-plan.due() // 1000)))

    def close(self) -> None:
        pass


def export_times(changes: DataFrame, debounce_s: float = 5.0, least_s: float = 30.0, latest_s: float = 120.0, delay: str = "1 minute") -> DataFrame:
    """key, at_us: when the changes (key long, at timestamp) of each key are written out, as Schedule says, each time once the watermark has passed it."""
    timed = changes.where("at IS NOT NULL").select("key", "at", F.unix_micros("at").alias("at_us")).withWatermark("at", delay)
    rules = [round(x * 1e6) for x in (debounce_s, least_s, latest_s)]
    return timed.groupBy("key").transformWithState(ExportTimes(*rules), "key long, at_us long", "append", "eventTime")
