"""Reads and updates of stored rows: lookups, probes, listings, claims, retention, changes that keep what they don't name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import DAY_MS


def by_ids(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows with one of the ids; none for an empty list. The filter reaches the scan."""
    return rows.where(F.col(key).isin(ids)) if ids else rows.where(F.lit(False))


def has_between(rows: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """One row, `present`: whether any row lies in the window, both ends counted. Empty tables have none."""
    return rows.where(F.col(column).between(lo, hi)).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def newest(rows: DataFrame, keys: list[str], lo: int, hi: int, most: int = 20) -> DataFrame:
    """The latest runs of each key within the window, numbered from the newest; ties go by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start_ms"), "id")
    return rows.where(F.col("start_ms").between(lo, hi)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)


def claimed(ledger: DataFrame, now_ms: int) -> DataFrame:
    """The ledger (day, status, attempts, next_ms, started_ms) after its oldest pending day, whose cooldown is over, was claimed."""
    free = ledger.where((F.col("status") == "pending") & (F.col("next_ms").isNull() | (F.col("next_ms") <= now_ms)))
    marked = ledger.join(F.broadcast(free.agg(F.min("day").alias("__day"))))  # one row
    mine = F.col("day").eqNullSafe(F.col("__day")) & F.col("day").isNotNull()
    take = lambda yes, name: F.when(mine, yes).otherwise(F.col(name)).alias(name)
    return marked.select("day", take(F.lit("running"), "status"), take(F.col("attempts") + 1, "attempts"), "next_ms", take(F.lit(now_ms), "started_ms"))


def next_claimable(ledger: DataFrame) -> DataFrame:
    """When the first pending day can be claimed, one without cooldown counting as 0; null if none is pending."""
    return ledger.where("status = 'pending'").agg(F.min(F.coalesce("next_ms", F.lit(0))).alias("next_ms"))


def retained(rows: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    """Without the rows that began more than so many days ago."""
    return rows.where(F.col("start_ms") >= now_ms - days * DAY_MS)


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The rows with the changed values; a null change, or none, keeps what was there. Changes have one row a key."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def pattern_view(stats: DataFrame) -> DataFrame:
    """Visible patterns of `patterns.pattern_stats`, the most often seen first and then the last seen, with the number of hidden ones of the same user."""
    hidden = F.sum(F.col("noise").cast("bigint")).over(Window.partitionBy("user_id"))
    shown = stats.withColumn("hidden", hidden).where("not noise").drop("noise")
    w = Window.partitionBy("user_id").orderBy(F.desc("seen"), F.desc("last_ms"), "app")
    return shown.withColumn("rank", F.row_number().over(w))


def carried_prefix(steps: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """Steps without a prefix "App: " (at most 60 characters) take that of the last step before them that has one."""
    own: Column = F.regexp_extract(step, "^(.{1,60}?): ", 1)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(own != "", own), ignorenulls=True).over(w)
    return steps.withColumn(step, F.when((own == "") & last.isNotNull(), F.concat(last, F.lit(": "), F.col(step))).otherwise(F.col(step)))
