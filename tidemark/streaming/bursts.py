"""Bursts of input: one row when a burst ends, and one whenever it has gone on for a while, so long bursts are told in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming import folds
from tidemark.streaming.folds import NEVER

#: So long without an event of a kind ends its burst; a burst is told after each MAX_MS.
QUIET_MS, MAX_MS = {"click": 3_000, "keyboard": 2_000, "scroll": 2_000}, 4_000
SCHEMA = "kind string, start_ms bigint, end_ms bigint, n bigint, told_ms bigint"


def _quiet(quiet_ms: dict[str, int]) -> Column:
    out = F.lit(None).cast("bigint")
    for kind, ms in sorted(quiet_ms.items()):
        out = F.when(F.col("kind") == kind, ms).otherwise(out)
    return out


def bursts(events: DataFrame, key: str = "user_id", quiet_ms: dict[str, int] = QUIET_MS, max_ms: int = MAX_MS, switch: str = "app") -> DataFrame:  # noqa: B006
    """key and SCHEMA: parts of bursts of a batch of events (key, at, id, kind). Kinds that quiet_ms lacks are left out; a switch ends all bursts.

    A part begins where the one before it had its last event; told_ms is when it is known: at the end of its length, when its burst has ended, or
    at the switch. An event just at such a time is after it; of equal times a switch goes by its id.
    """
    w = Window.partitionBy(key).orderBy("at", "id")
    switched = F.when(F.col("kind") == switch, F.col("at"))
    later = F.min(switched).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = events.where(F.col("kind").isin([*quiet_ms, switch])).select(key, "at", "id", "kind", F.sum((F.col("kind") == switch).cast("bigint")).over(w).alias("part"), later.alias("switch_at"))
    rows = rows.where(F.col("kind").isin(list(quiet_ms))).withColumn("quiet", _quiet(quiet_ms))
    own = Window.partitionBy(key, "kind", "part").orderBy("at", "id")
    rows = rows.withColumn("burst", F.sum(F.when(F.col("at") - F.lag("at").over(own) < F.col("quiet"), 0).otherwise(1)).over(own))
    whole = [key, "kind", "part", "burst"]
    rows = rows.withColumn("first", F.min("at").over(Window.partitionBy(*whole))).withColumn("i", F.floor((F.col("at") - F.col("first")) / max_ms))
    parts = rows.groupBy(*whole, "first", "i", "quiet").agg(F.max("at").alias("end_ms"), F.count(F.lit(1)).alias("n"), F.max("switch_at").alias("switch_at"))
    before = F.lag("end_ms").over(Window.partitionBy(*whole).orderBy("i"))
    told = F.least(F.col("end_ms") + F.col("quiet"), F.col("first") + (F.col("i") + 1) * max_ms, F.col("switch_at"))
    return parts.select(key, "kind", F.coalesce(before, "first").alias("start_ms"), "end_ms", "n", told.cast("bigint").alias("told_ms"))


class BurstMachine:
    """Records: (at, id, kind)."""

    def __init__(self, quiet_ms: dict[str, int], max_ms: int, switch: str) -> None:
        self.quiet_ms, self.max_ms, self.switch = quiet_ms, max_ms, switch
        self.going: dict[str, list] = {}  # kind: start of the part, last event, events, when it is told, when it is quiet

    def due(self) -> int:
        return min((min(b[3], b[4]) for b in self.going.values()), default=NEVER)

    def advance(self, now: int) -> list[tuple]:
        out = []
        while (when := self.due()) <= now:
            kind = min(k for k, b in self.going.items() if min(b[3], b[4]) == when)
            b = self.going[kind]
            out += self._told(kind, when)
            if b[4] <= when:
                del self.going[kind]
            else:
                b[0], b[2], b[3] = b[1], 0, b[3] + self.max_ms
        return out

    def take(self, record: tuple) -> list[tuple]:
        at, _, kind = record
        out = self.advance(at)
        if kind == self.switch:
            out += [x for k in sorted(self.going) for x in self._told(k, at)]
            self.going = {}
        elif kind in self.quiet_ms:
            b = self.going.setdefault(kind, [at, at, 0, at + self.max_ms, 0])
            b[1], b[2], b[4] = at, b[2] + 1, at + self.quiet_ms[kind]
        return out

    def _told(self, kind: str, at: int) -> list[tuple]:
        start, last, n, _, _ = self.going[kind]
        return [(kind, start, last, n, at)] if n else []

    def end(self) -> list[tuple]:
        return self.advance(NEVER - 1)


def stream_bursts(events: DataFrame, key: str = "user_id", quiet_ms: dict[str, int] = QUIET_MS, max_ms: int = MAX_MS, switch: str = "app") -> DataFrame:  # noqa: B006
    """The same on a stream whose watermark is on the time of `at`: long bursts are told while they go on."""
    return folds.stream(events, [key], ["at", "id", "kind"], lambda k: BurstMachine(quiet_ms, max_ms, switch), SCHEMA)
