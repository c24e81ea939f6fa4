"""Timeline: overlap filters, sampled browsing, rollup runs, context carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import mentions

DAY_MS = 86_400_000


def overlapping(acts: DataFrame, start: int | None = None, end: int | None = None, app: str | None = None) -> DataFrame:
    """Activities that overlap [start, end], both inclusive; app is a literal part of the app or title, case-insensitive."""
    out = acts if start is None else acts.where(F.col("end_ms") >= start)
    out = out if end is None else out.where(F.col("start_ms") <= end)
    if app:
        out = out.where(F.contains(F.lower("app"), F.lit(app.lower())) | F.contains(F.lower("title"), F.lit(app.lower())))
    return out


def recent(acts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first; the limit is held to 1..500 and the offset to 0 or more."""
    return acts.orderBy(F.desc("start_ms"), F.desc("id")).offset(max(0, int(offset))).limit(min(500, max(1, int(limit))))


def day_of(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("bigint")


def rollup_runs(acts: DataFrame, gap_ms: int = 90_000) -> DataFrame:
    """Runs of one user's day: neighbours with the same app and title and at most gap_ms between them."""
    w = Window.partitionBy("user_id", "day").orderBy("start_ms", "id")
    rows = acts.withColumn("day", day_of(F.col("start_ms")))
    same = (F.lag("app").over(w) == F.col("app")) & (F.lag("title").over(w) == F.col("title")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    rows = rows.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return rows.groupBy("user_id", "day", "run").agg(F.first("app").alias("app"), F.first("title").alias("title"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def day_summary(runs: DataFrame) -> DataFrame:
    """For each user and day the number of runs and captures and the sum of run lengths."""
    return runs.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("captures"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("run_ms"))


def sample_uniform(acts: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """Of each key's n activities in time order those at round(i (n - 1) / (limit - 1)); all where there are no more than limit."""
    if limit <= 0:
        return acts.limit(0)
    w = Window.partitionBy(key)
    rows = acts.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("start_ms", "id")) - 1)
    if limit == 1:
        return rows.where("i = 0").drop("n", "i")
    # i is chosen if some k in 0..limit-1 rounds to it: the least k that could is found in closed form
    k = F.ceil((F.col("i") - 0.5) * (limit - 1) / (F.col("n") - 1))
    hit = (F.floor(F.greatest(k, F.lit(0)) * (F.col("n") - 1) / (limit - 1) + 0.5) == F.col("i")) & (k <= limit - 1)
    return rows.where((F.col("n") <= limit) | hit).drop("n", "i")


def carried(acts: DataFrame, column: str) -> DataFrame:
    """The latest value of the column that isn't null, carried forward along each user's activities."""
    w = Window.partitionBy("user_id").orderBy("start_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return acts.withColumn("carried", F.last(column, ignorenulls=True).over(w))


def around(acts: DataFrame, t_ms: int, minutes: int) -> DataFrame:
    """Activities within so many minutes of a time, but of its day only."""
    day = t_ms // DAY_MS * DAY_MS
    return overlapping(acts, max(day, t_ms - minutes * 60_000), min(day + DAY_MS - 1, t_ms + minutes * 60_000))


def audited(acts: DataFrame, app: str | None = None, text: str | None = None) -> DataFrame:
    """Activities of exactly this app whose app or title has the text in it, whatever the case; what is not given does not filter."""
    out = acts if app is None else acts.where(F.col("app") == app)
    return out if not text else out.where(mentions(text, F.col("app"), F.col("title")))
