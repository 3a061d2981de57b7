"""The attempt machine: what an event does to a running attempt. Plain Python over a small state, so batch and stream share it."""

from __future__ import annotations

from dataclasses import dataclass, field

MISSES = 5
EXPIRY_US = 24 * 3_600_000_000
ACTIVE, PAUSED, FINISHED, EXPIRED = "active", "paused", "finished", "expired"


@dataclass
class Attempt:
    """State of one attempt; times are microseconds, 0 is none."""

    status: str = ACTIVE
    poll: str = ""
    sent: int = 0
    index: int = 0
    streak: int = 0
    epoch: int = 0
    started: int = 0
    paused_at: int = 0
    paused_total: int = 0
    before_pause: int = 0
    correct: int = 0
    wrong: int = 0
    skipped: int = 0
    timeouts: int = 0
    run: int = 0
    out: list[dict] = field(default_factory=list)

    def _tell(self, ts: int, kind: str, **more: object) -> None:
        self.out.append({"ts": ts, "kind": kind, "index": self.index, "run": self.run, "status": "", "elapsed_us": 0} | more)

    def apply(self, kind: str, ts: int, poll: str = "", right: bool = False) -> bool:
        """Whether the event took effect. One that comes for another poll, while paused, or after the end takes none."""
        if self.status in (FINISHED, EXPIRED) and kind != "restart":
            return False
        if self.started and ts - self.started - self._paused(ts) > EXPIRY_US and kind != "restart":
            self.status = EXPIRED
            self._tell(ts, EXPIRED)
            return False
        done = getattr(self, "_" + kind, None)
        took = bool(done and done(ts, poll, right))
        self.epoch += took
        return took

    def _paused(self, ts: int) -> int:
        return self.paused_total + (max(0, ts - self.paused_at) if self.status == PAUSED else 0)

    def _sent(self, ts: int, poll: str, right: bool) -> bool:
        if self.status != ACTIVE:
            return False
        self.started = self.started or ts
        self.poll, self.sent, self.before_pause = poll, ts, 0
        return True

    def _record(self, ts: int, status: str) -> bool:
        elapsed = max(0, ts - self.sent) + self.before_pause if self.poll else 0
        self._tell(ts, "answer", status=status, elapsed_us=elapsed)
        answered = status in ("correct", "wrong")
        self.streak = 0 if answered else self.streak + bool(self.poll)
        name = {"timeout": "skipped"}.get(status, status)
        setattr(self, name, getattr(self, name) + 1)
        self.timeouts += status == "timeout"
        self.index, self.poll, self.sent, self.before_pause = self.index + 1, "", 0, 0
        if self.streak >= MISSES:
            self._pause(ts, "", False)
            self.streak = 0
        return True

    def _answer(self, ts: int, poll: str, right: bool) -> bool:
        live = self.status == ACTIVE and self.poll and self.poll == poll
        return bool(live) and self._record(ts, "correct" if right else "wrong")

    def _timeout(self, ts: int, poll: str, right: bool) -> bool:
        return bool(self.status == ACTIVE and self.poll and self.poll == poll) and self._record(ts, "timeout")

    def _skip(self, ts: int, poll: str, right: bool) -> bool:
        return self.status == ACTIVE and self._record(ts, "skipped")

    def _pause(self, ts: int, poll: str, right: bool) -> bool:
        if self.status != ACTIVE:
            return False
        self.status, self.paused_at = PAUSED, ts
        self.before_pause += max(0, ts - self.sent) if self.poll else 0
        self._tell(ts, "pause")
        return True

    def _resume(self, ts: int, poll: str, right: bool) -> bool:
        if self.status != PAUSED:
            return False
        self.status, self.paused_total = ACTIVE, self.paused_total + max(0, ts - self.paused_at)
        self.paused_at, self.sent = 0, ts if self.poll else 0
        self._tell(ts, "resume")
        return True

    def _finish(self, ts: int, poll: str, right: bool) -> bool:
        duration = max(0, ts - self.started - self._paused(ts)) if self.started else 0
        self.status, self.poll = FINISHED, ""
        self._tell(ts, FINISHED, elapsed_us=duration)
        return True

    def _restart(self, ts: int, poll: str, right: bool) -> bool:
        """Ends this run and begins another, counted from it."""
        if self.status in (ACTIVE, PAUSED):
            self._finish(ts, poll, right)
        fresh = Attempt(run=self.run + 1, epoch=self.epoch, out=self.out)
        self.__dict__.update(fresh.__dict__)
        self._tell(ts, "restart")
        return True


STATE = "status string, poll string, sent long, index long, streak long, epoch long, started long, paused_at long, paused_total long, before_pause long, correct long, wrong long, skipped long, timeouts long, run long"
OUTPUT = "attempt_id long, ts long, kind string, index long, run long, status string, elapsed_us long"
FIELDS = [f.split()[0] for f in STATE.split(", ")]


@dataclass
class Schedule:
    """When changes are written out: after a quiet spell, never sooner than `least` after the last time, never later than `latest` after the first change. Times are microseconds."""

    debounce: int
    least: int
    latest: int
    first: int | None = None
    last: int | None = None
    before: int | None = None

    def due(self) -> int:
        free = self.before + self.least if self.before is not None else 0
        return max(min(self.last + self.debounce, self.first + self.latest), free)

    def until(self, now: int) -> list[int]:
        """The time that has come by now, if changes are open."""
        if self.first is None or self.due() > now:
            return []
        self.before, self.first, self.last = self.due(), None, None
        return [self.before]

    def change(self, at: int) -> list[int]:
        """Takes a change, the next in order; what has come before it."""
        out = self.until(at)
        self.first, self.last = at if self.first is None else self.first, at
        return out


def export_times(changes: list[float], debounce: float = 5.0, least: float = 30.0, latest: float = 120.0) -> list[float]:
    """All times of a change log, in seconds."""
    plan = Schedule(*(round(x * 1e6) for x in (debounce, least, latest)))
    out = [due for at in sorted(changes) for due in plan.change(round(at * 1e6))]
    return [x / 1e6 for x in out + (plan.until(plan.due()) if changes else [])]
