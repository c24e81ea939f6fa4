"""Event windows: a user's events between two switches of app, idle times or full lengths, with late events let in for a while after the close.

Records come in order of arrival (`at`); their own time (`ts`) may be earlier, since a burst is told when it ends.
"""

from __future__ import annotations

import os.path
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming import folds
from tidemark.streaming.folds import NEVER

COLUMNS = ["at", "id", "kind", "ts", "app", "title", "typed"]
SCHEMA = "start_ms bigint, end_ms bigint, closed_by string, n bigint, ids array<bigint>, app string, title string, emitted_ms bigint"


@dataclass(frozen=True)
class Rules:
    """Lengths in milliseconds. max_ms: a window is closed and the next one opened; grace_ms: late events are let in so long after a close; idle_ms:
    so long without a record is idle (None: only `idle` records are); typed_ms: a title edited so soon after typing is no switch, in typed_apps."""

    max_ms: int = 300_000
    grace_ms: int = 3_500
    idle_ms: int | None = 90_000
    typed_ms: int = 2_000
    typed_apps: frozenset[str] = frozenset({"notepad"})


@dataclass
class _Window:
    start: int
    full: int  # when it has its full length
    events: list[tuple] = field(default_factory=list)
    retitled: int = 0
    closed_by: str = ""
    bound: int = 0
    till: int = 0  # the latest event time that is let in
    least_end: int = 0
    due: int = 0


def typed_edit(old: str | None, new: str | None) -> bool:
    """Whether one title is the other with one run of signs put in."""
    if not old or not new or old == new:
        return False
    head = len(os.path.commonprefix([old, new]))
    tail = len(os.path.commonprefix([old[::-1], new[::-1]]))
    return head + tail >= min(len(old), len(new))


class WindowMachine:
    """Records: (at, id, kind, ts, app, title, typed). kind: `app` (a switch), `idle` (ts: the last input), `return`, `flush`; all others are events.

    typed tells that an event was typing that edits text. Rows of SCHEMA come in order of closing.
    """

    def __init__(self, rules: Rules, away: bool = False) -> None:
        self.rules, self.away, self.away_app = rules, away, None
        self.open: _Window | None = None
        self.next_start: int | None = None
        self.closing: list[_Window] = []
        self.idle_at, self.last_ts = NEVER, 0

    # -- time ------------------------------------------------------------------

    def due(self) -> int:
        return min(self.closing[0].due if self.closing else NEVER, self.open.full if self.open else NEVER, self.idle_at)

    def advance(self, now: int) -> list[tuple]:
        out = []
        while (when := self.due()) <= now:
            if self.closing and self.closing[0].due == when:
                out.append(self._row(self.closing.pop(0), when))
            elif self.open and self.open.full == when:
                out += self._close("max_duration", when, when, when, when)
                self._begin(when, when)
            else:
                out += self._idle(when, self.last_ts)
        return out

    def end(self) -> list[tuple]:
        """All that is open is flushed at the last record's time."""
        out = self._close("flush", self.last_ts, self.last_ts, self.last_ts, self.last_at, 0) if self.open else []
        return out + [self._row(self.closing.pop(0), self.last_at) for _ in range(len(self.closing))]

    # -- records -----------------------------------------------------------------

    def take(self, record: tuple) -> list[tuple]:
        at, _, kind, ts, app, title, _ = record
        out = self.advance(at)
        self.last_at, self.last_ts = at, at if ts is None else ts
        if kind == "idle":
            return out + self._idle(at, self.last_ts)
        if self.rules.idle_ms is not None and not (kind == "app" and self.away):
            self.idle_at = at + self.rules.idle_ms
        if kind == "return":
            self.away = False
            if self.open is None:
                self._begin(self.last_ts, at)
            return out
        if kind == "flush":
            if self.open:
                out += self._close("flush", self.last_ts, self.last_ts, self.last_ts, at, 0)
            return out
        if kind == "app":
            if self.away:
                self.away_app = record
                return out
            if self._retitled(record):
                return out
            if self.open:
                out += self._close("app_change", self.last_ts, self.last_ts - 1, self.last_ts, at)
                self.next_start = self.last_ts
        else:
            for w in reversed(self.closing):
                if self.last_ts <= w.till:
                    w.events.append(record)
                    return out
        if self.open is None:
            self._begin(self.last_ts, at)
        self.away = False
        self.open.events.append(record)
        return out

    def _begin(self, start: int, at: int) -> None:
        start, self.next_start = start if self.next_start is None else self.next_start, None
        self.open = _Window(start, at + self.rules.max_ms)
        if self.away_app is not None:
            a, i, kind, _, app, title, typed = self.away_app
            self.open.events.append((a, i, kind, start, app, title, typed))
            self.away_app = None

    def _retitled(self, record: tuple) -> bool:
        """A title that typing has changed is the same window's new title."""
        at, _, _, ts, app, title, _ = record
        if self.open is None or not self.open.events or (app or "").lower() not in self.rules.typed_apps:
            return False
        events = self.open.events
        k = next((k for k in range(len(events) - 1, -1, -1) if events[k][2] == "app"), None)
        typed, last = events[-1][6], events[-1][3]
        if k is None or not typed or self.last_ts - last > self.rules.typed_ms or events[k][4] != app or not typed_edit(events[k][5], title):
            return False
        events[k] = (*events[k][:5], title, events[k][6])
        self.open.retitled = self.last_ts
        return True

    def _idle(self, at: int, last_input: int) -> list[tuple]:
        self.away, self.idle_at = True, NEVER
        return self._close("gap", at, at, last_input, at) if self.open else []

    def _close(self, why: str, bound: int, till: int, last_input: int, at: int, grace: int | None = None) -> list[tuple]:
        w, self.open = self.open, None
        least = max(last_input, w.retitled)
        if not w.events and least <= w.start:
            return []
        w.closed_by, w.bound, w.till, w.least_end = why, bound, till, least
        w.due = at + (self.rules.grace_ms if grace is None else grace)
        self.closing.append(w)
        if w.due > at:
            return []
        # One that isn't held takes all before it along, so windows come in order of closing.
        return [self._row(self.closing.pop(0), at) for _ in range(len(self.closing))]

    def _row(self, w: _Window, at: int) -> tuple:
        end = w.bound if w.closed_by == "app_change" else max([w.least_end, *(e[0] if e[3] is None else e[3] for e in w.events)])
        shown = next((e for e in reversed(w.events) if e[4]), None)
        return w.start, max(w.start, end), w.closed_by, len(w.events), [e[1] for e in w.events], shown and shown[4], shown and shown[5], at


class _Part(WindowMachine):
    """For a part of a key: the last column of a record tells whether the part ends with it and another follows, after a long idle time."""

    def take(self, record: tuple) -> list[tuple]:
        self.more = record[-1]
        return super().take(record[:-1])

    def end(self) -> list[tuple]:
        return self.advance(self.last_at + self.rules.idle_ms + self.rules.grace_ms) if self.more else super().end()


def from_activities(acts: DataFrame, switch: str = "view") -> DataFrame:
    """Records of activities: each is told when it ends, and those of one app are switches, to their title."""
    at = F.greatest("start_ms", "end_ms")
    return acts.select("user_id", at.alias("at"), "id", F.when(F.col("app") == switch, "app").otherwise(F.col("app")).alias("kind"), F.col("start_ms").alias("ts"), F.when(F.col("app") == switch, F.col("title")).alias("app"), F.col("title"), F.lit(False).alias("typed"))


def event_windows(records: DataFrame, key: str = "user_id", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """key, and SCHEMA: the windows of a batch of records (key and COLUMNS). What is open at the end is flushed at the last record's time.

    A long idle time ends all that a machine holds, so a key is divided there and its parts run in tasks of their own; a key's records are
    never held together. `at` and `id` must not be null; a null ts is at.
    """
    w = Window.partitionBy(key).orderBy("at", "id")
    rows = records.select(key, *COLUMNS)
    if rules.idle_ms is None:
        rows = rows.withColumn("part", F.lit(0).cast("bigint")).withColumn("more", F.lit(False))
    else:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        rested = F.col("at") - F.lag("at").over(w) > rules.idle_ms + rules.grace_ms
        # A switch may wait for a return across the idle time, and so may one that came just before a late event.
        switch = F.max(F.when(F.col("kind") == "app", F.col("at"))).over(before)
        plain = (F.lag("kind").over(w) != "app") & (F.lag("kind").over(w) != "return") & (switch.isNull() | (F.lag("at").over(w) - switch > rules.grace_ms))
        rows = rows.withColumn("cut", F.when(rested & plain, 1).otherwise(0)).withColumn("part", F.sum("cut").over(w))
        rows = rows.withColumn("more", F.coalesce(F.lead("cut").over(w) == 1, F.lit(False)))
    return folds.batch(rows, [key, "part"], [*COLUMNS, "more"], lambda k: _Part(rules, away=k[1] > 0), SCHEMA).drop("part")


def stream_windows(records: DataFrame, key: str = "user_id", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The same on a stream whose watermark is on the time of `at`. What is open stays open: it is emitted when later records, or idle time, close it."""
    return folds.stream(records, [key], COLUMNS, lambda k: WindowMachine(rules), SCHEMA)
