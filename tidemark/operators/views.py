"""The view of recurring patterns: titles, steps, statistics and search over clusters and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import mentions
from tidemark.operators.timeline import DAY_MS


def clusters_view(clusters: DataFrame, members: DataFrame, key: list[str], now_ms: int, days: int = 28, least_seen: int = 2, least_ms: int = 1_800_000) -> DataFrame:
    """Clusters (key, label, steps) with what their members (key, id, title, steps, app, start_ms, active_ms) of the last days tell: title, steps, seen, mean_ms, last_ms, apps and noise.

    The title is the label, else the commonest trimmed title that isn't empty, of ties the first to occur, else `Untitled task`. The steps are the
    cluster's, else those of the latest member with steps that bears the commonest title, else of the latest with any. Clusters without a
    member in time are left out; noise tells those seen too seldom and for too short a time. Members are summed up before they are shuffled.
    """
    rows = members.where((F.col("start_ms") > now_ms - days * DAY_MS) & (F.col("start_ms") <= now_ms)).withColumn("title", F.trim(F.coalesce("title", F.lit(""))))
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("seen"), F.sum("active_ms").alias("total_ms"), F.max("start_ms").alias("last_ms"), F.sort_array(F.collect_set("app")).alias("apps"))
    titles = rows.where("title <> ''").groupBy(*key, "title").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_ms", "id")).alias("first"))
    modal = titles.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "title")).alias("m")).select(*key, F.col("m.title").alias("modal"))
    latest = rows.where(F.size("steps") > 0).join(modal, key, "left").groupBy(*key).agg(F.max(F.struct((F.col("title") == F.coalesce("modal", F.lit(""))).alias("same"), "start_ms", "id", "steps")).alias("s")).select(*key, F.col("s.steps").alias("own"))
    out = clusters.select(*key, F.trim(F.coalesce("label", F.lit(""))).alias("label"), F.col("steps").alias("told")).join(stats, key).join(modal, key, "left").join(latest, key, "left")
    title = F.when(F.col("label") != "", F.col("label")).otherwise(F.coalesce("modal", F.lit("Untitled task")))
    steps = F.when(F.size("told") > 0, F.col("told")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    noise = (F.col("seen") < least_seen) & (F.col("total_ms") < least_ms)
    return out.select(*key, title.alias("title"), steps.alias("steps"), "seen", F.floor(F.col("total_ms") / F.col("seen")).alias("mean_ms"), "last_ms", "apps", noise.alias("noise"))


def listed(view: DataFrame, by: list[str]) -> DataFrame:
    """The visible clusters of each `by`, the most often seen first, then the last seen, then by title, with their rank and how many are hidden."""
    w = Window.partitionBy(*by)
    shown = view.withColumn("hidden", F.sum(F.col("noise").cast("bigint")).over(w)).where("not noise").drop("noise")
    return shown.withColumn("rank", F.row_number().over(w.orderBy(F.desc("seen"), F.desc("last_ms"), "title")))


def searched(view: DataFrame, text: str) -> DataFrame:
    """Visible clusters that have the text in their title, a step or an app, whatever the case; a blank text finds none."""
    if not text.strip():
        return view.limit(0)
    return view.where("not noise").where(mentions(text.strip(), F.col("title"), F.array_join("steps", "\n"), F.array_join("apps", "\n")))


def recent_first(acts: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """The last `limit` activities of each key, in order of time with their place among those shown, and how many there were: a listing without a query."""
    w = Window.partitionBy(key)
    rows = acts.withColumn("of", F.count(F.lit(1)).over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("start_ms"), F.desc("id")))).where(F.col("back") <= max(0, limit))
    return rows.withColumn("place", (F.least("of", F.lit(limit)) + 1 - F.col("back")).cast("int")).drop("back")
