"""Interval analytics: unions, gaps, densest runs, nearest and as-of matches, range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(acts: DataFrame, keys: list[str], bridge_ms: int = 0) -> DataFrame:
    """Maximal unions of intervals of each key; touching intervals, and gaps of at most bridge_ms, merge. An end before its start counts as the start."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    rows = acts.select(*keys, "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"))
    seen = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum(F.when(F.col("start_ms") <= seen + bridge_ms, 0).otherwise(1)).over(w))
    return rows.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def active_time(acts: DataFrame, keys: list[str], bridge_ms: int = 0) -> DataFrame:
    """Milliseconds covered by any interval of a key, and the minutes to a tenth."""
    total = F.sum(F.col("end_ms") - F.col("start_ms"))
    return islands(acts, keys, bridge_ms).groupBy(*keys).agg(total.alias("active_ms"), F.round(total / 60000, 1).alias("active_min"))


def largest_gap(acts: DataFrame, key: str = "user_id") -> DataFrame:
    """The longest time between neighbouring starts of a key, and where it begins (of ties the first)."""
    w = Window.partitionBy(key).orderBy("start_ms", "id")
    gaps = acts.select(key, "start_ms", (F.lead("start_ms").over(w) - F.col("start_ms")).alias("gap_ms")).where("gap_ms is not null")
    return gaps.groupBy(key).agg(F.max("gap_ms").alias("gap_ms"), F.max_by("start_ms", F.struct("gap_ms", (-F.col("start_ms")).alias("first"))).alias("after_ms"))


def densest_run(acts: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """The n consecutive activities of a key with the least span from first to last start (of ties the first)."""
    w = Window.partitionBy(key).orderBy("start_ms", "id")
    spans = acts.select(key, "start_ms", (F.lead("start_ms", n - 1).over(w) - F.col("start_ms")).alias("span_ms")).where("span_ms is not null")
    return spans.groupBy(key).agg(F.min("span_ms").alias("span_ms"), F.min_by("start_ms", F.struct("span_ms", "start_ms")).alias("from_ms"))


def durations_by_lead(frames: DataFrame, key: str = "user_id", least_ms: int = 1000) -> DataFrame:
    """Each frame lasts until the next one; where that is no time, least_ms; the last lasts as long as the one before it."""
    w = Window.partitionBy(key).orderBy("start_ms", "id")
    rows = frames.select(key, "id", "start_ms", (F.lead("start_ms").over(w) - F.col("start_ms")).alias("d"))
    rows = rows.withColumn("d", F.when(F.col("d") <= 0, least_ms).otherwise(F.col("d")))
    return rows.select(key, "id", F.coalesce("d", F.lag("d").over(w), F.lit(least_ms)).alias("duration_ms"))


def as_of(left: DataFrame, right: DataFrame, key: str, direction: str = "nearest") -> DataFrame:
    """For each (key, t) of left the latest t of right at or before it, the first at or after it, or the nearer of both (of ties the earlier).

    Both sides are merged in time order within a key, once in either direction, so no pair is formed and each frame only grows.
    """
    both = left.select(key, "t", F.lit(1).alias("asks")).unionByName(right.select(key, "t", F.lit(0).alias("asks")))
    w = Window.partitionBy(key).orderBy("t")
    own = F.when(F.col("asks") == 0, F.col("t"))
    down = Window.partitionBy(key).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    rows = both.select(key, "t", "asks", F.max(own).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("before"), F.min(own).over(down).alias("after")).where("asks = 1")
    nearer = F.when(F.col("t") - F.col("before") <= F.col("after") - F.col("t"), F.col("before")).otherwise(F.coalesce("after", "before"))
    match = {"backward": F.col("before"), "forward": F.col("after"), "nearest": nearer}[direction]
    return rows.select(key, "t", match.alias("match"))


def dealt_windows(windows: DataFrame, key: str, slot_ms: int) -> DataFrame:
    """Windows (key, start_ms, end_ms, window) dealt to time slots: the slots of a window are as wide as it is long, rounded up to slot_ms times a
    power of two (level), so it touches two of them at most. Windows that end before they start are left out."""
    rows = windows.where("end_ms >= start_ms").select(key, "start_ms", "end_ms", "window", F.greatest(F.lit(0), F.ceil(F.log2((F.col("end_ms") - F.col("start_ms") + 1) / slot_ms))).cast("int").alias("level"))
    wide = F.expr(f"shiftleft({slot_ms}L, level)")
    return rows.withColumn("slot", F.explode(F.array_distinct(F.array(F.floor(F.col("start_ms") / wide), F.floor(F.col("end_ms") / wide)))))


def contained(points: DataFrame, windows: DataFrame, key: str, slot_ms: int) -> DataFrame:
    """Points (key, t, id) with the windows (key, start_ms, end_ms, window) that hold them, both ends inclusive.

    The join is on key, level and slot. A point goes to one slot of each level that some window has; there are as many levels as lengths differ
    by powers of two, 60 at most, and one where all windows are shorter than slot_ms.
    """
    dealt = dealt_windows(windows, key, slot_ms)
    levels = sorted(r["level"] for r in dealt.select("level").distinct().collect())
    level = F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>")).alias("level")
    placed = points.select("*", level).withColumn("slot", F.floor(F.col("t") / F.expr(f"shiftleft({slot_ms}L, level)")))
    return placed.join(dealt, [key, "level", "slot"]).where((F.col("t") >= F.col("start_ms")) & (F.col("t") <= F.col("end_ms"))).drop("level", "slot")
