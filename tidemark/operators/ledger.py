"""Upkeep of tables: days not yet done, rows since the last export, the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeline import DAY_MS


def missing_days(acts: DataFrame, done: DataFrame, now_ms: int, back: int = 60) -> DataFrame:
    """(day): of the last `back` days before today, those not in done and not before the first activity; none where there is no activity."""
    today, oldest = now_ms // DAY_MS, acts.agg(F.min("start_ms")).first()[0]
    first = today if oldest is None else max(today - back, oldest // DAY_MS)
    return acts.sparkSession.range(first, max(first, today)).withColumnRenamed("id", "day").join(done.select("day"), "day", "left_anti")


def delta(acts: DataFrame, mark_ms: int | None, overlap_ms: int = 3_600_000) -> DataFrame:
    """What to export after a mark: rows that end at most the overlap before it, or later; all rows if there is no mark."""
    return acts if mark_ms is None else acts.where(F.col("end_ms") >= mark_ms - overlap_ms)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in this order: an upsert of rows that were only appended. The maximum is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *(f"r.{c}" for c in order + rest))
