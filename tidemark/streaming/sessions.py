"""Sessions of a user's events on streams, closed by idle time, with late events let in up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, idle: str = "90 seconds", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of (key, ts timestamp, app): they end after `idle` without an event. Events later than `late` are dropped on a stream.

    Works on a batch and on a stream alike; on a stream a session is emitted, in append mode, when the watermark passes its end. A session
    keeps its distinct apps, of which there are few.
    """
    rows = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", idle).alias("w"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.size(F.collect_set("app")).cast("bigint").alias("apps"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "first_ts", "last_ts", "apps")
