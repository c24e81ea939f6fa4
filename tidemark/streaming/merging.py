"""Activities from event windows: windows are cut to chunks, and neighbouring chunks of one context merge up to a length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import contained
from tidemark.streaming import folds
from tidemark.streaming.folds import NEVER

MIN_MS, MAX_MS = 3_000, 300_000
COLUMNS = ["at", "window", "end_ms", "app", "bundle", "host", "display", "browser", "flush"]
SCHEMA = "start_ms bigint, end_ms bigint, app string, host string, n_chunks bigint, windows array<bigint>, why string"


def chunks(windows: DataFrame, max_ms: int = MAX_MS) -> DataFrame:
    """Windows (start_ms, end_ms, ...) cut to chunks of at most max_ms, both ends inclusive: their columns, and at and chunk_end. A window that ends before it starts has none."""
    rows = windows.where("end_ms >= start_ms").withColumn("at", F.explode(F.sequence("start_ms", "end_ms", F.lit(max_ms).cast("bigint"))))
    return rows.withColumn("chunk_end", F.least("end_ms", F.col("at") + max_ms - 1))


def with_frames(parts: DataFrame, frames: DataFrame, key: str, slot_ms: int) -> DataFrame:
    """Chunks that hold a frame (key, t) at least. Chunks of one window have distinct starts."""
    held = contained(frames.select(key, "t"), parts.select(key, F.col("at").alias("start_ms"), F.col("chunk_end").alias("end_ms"), "window"), key, slot_ms)
    some = held.select(key, "window", F.col("start_ms").alias("at")).distinct()
    return parts.join(some, [key, "window", "at"], "left_semi")


class MergeMachine:
    """Records of COLUMNS: chunks in order. A chunk joins the pending activity if their contexts go together and, from its start to the chunk's end, it is no longer than max_ms."""

    def __init__(self, min_ms: int, max_ms: int) -> None:
        self.min_ms, self.max_ms, self.pending = min_ms, max_ms, None

    def due(self) -> int:
        return NEVER

    def advance(self, now: int) -> list[tuple]:
        return []

    def take(self, record: tuple) -> list[tuple]:
        at, window, end, *context, flush = record
        out = []
        if self.pending is not None:
            start, _, own, _, _ = self.pending
            fits = end - start <= self.max_ms
            if fits and goes_with(own, context):
                self.pending[1] = max(self.pending[1], end)
                self.pending[3] += 1
                self.pending[4].add(window)
            else:
                out = self._done("context_change" if fits else "max_duration")
        if self.pending is None:
            self.pending = [at, end, context, 1, {window}]
        return out + self._done("flush") if flush else out

    def _done(self, why: str) -> list[tuple]:
        start, end, context, n, windows = self.pending
        self.pending = None
        return [] if end - start < self.min_ms else [(start, end, context[0], context[2], n, sorted(windows), why)]

    def end(self) -> list[tuple]:
        return self._done("flush") if self.pending is not None else []


def goes_with(a: list, b: list) -> bool:
    """Whether two contexts (app, bundle, host, display, browser) are one: no two known displays, one app (by bundle where both have one), and in a browser one known host."""
    (app, bundle, host, display, browser), (app2, bundle2, host2, display2, _) = a, b
    if display is not None and display2 is not None and display != display2:
        return False
    if (bundle != bundle2) if bundle and bundle2 else (app != app2):
        return False
    return not browser or bool(host) and host == host2


def _records(parts: DataFrame) -> DataFrame:
    return parts.select("*", F.col("end_ms").alias("__window_end")).drop("end_ms").withColumnRenamed("chunk_end", "end_ms").withColumn("flush", F.coalesce("flush", F.lit(False)) & (F.col("end_ms") == F.col("__window_end")))


def merged(parts: DataFrame, key: str = "user_id", min_ms: int = MIN_MS, max_ms: int = MAX_MS) -> DataFrame:
    """key and SCHEMA: activities from chunks (key, window, end_ms, at, chunk_end, app, bundle, host, display, browser, flush), those under min_ms left out.

    Chunks go by start and window. Where even the chunk before is too far back, an activity ends for certain: a key is divided there, so its
    parts run in tasks of their own. flush: the window ends what is pending.
    """
    rows = _records(parts)
    w = Window.partitionBy(key).orderBy("at", "window")
    apart = F.coalesce(F.col("end_ms") - F.lag("at").over(w) > max_ms, F.lit(False)).cast("bigint")
    rows = rows.withColumn("apart", apart).withColumn("part", F.sum("apart").over(w))
    last = F.lead("apart").over(w) == 1
    # What the division ends, the next chunk would have ended by length.
    done = folds.batch(rows.withColumn("cut", F.coalesce(last, F.lit(False))), [key, "part"], COLUMNS + ["cut"], lambda k: _Divided(min_ms, max_ms), SCHEMA)
    return done.drop("part")


class _Divided:
    """A MergeMachine whose last record tells that the length would end it."""

    def __init__(self, min_ms: int, max_ms: int) -> None:
        self.inner, self.cut = MergeMachine(min_ms, max_ms), False

    def due(self) -> int:
        return NEVER

    def advance(self, now: int) -> list[tuple]:
        return []

    def take(self, record: tuple) -> list[tuple]:
        self.cut = record[-1]
        return self.inner.take(record[:-1])

    def end(self) -> list[tuple]:
        return self.inner._done("max_duration" if self.cut else "flush") if self.inner.pending is not None else []


def stream_merged(parts: DataFrame, key: str = "user_id", min_ms: int = MIN_MS, max_ms: int = MAX_MS) -> DataFrame:
    """The same on a stream of chunks whose watermark is on the time of `at`: an activity comes when a later chunk doesn't fit, or a flush ends it."""
    return folds.stream(_records(parts), [key], COLUMNS, lambda k: MergeMachine(min_ms, max_ms), SCHEMA)
