"""Profiles of activities, costs, and the queues and samples that reviews work through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals

#: Centroids are sent to every task in blocks of so many.
CENTROID_BLOCK = 4096


def app_hours(acts: DataFrame, most: int = 15) -> DataFrame:
    """The apps with most time: hours to a tenth, and their activities."""
    total = F.sum(F.col("end_ms") - F.col("start_ms"))
    rows = acts.groupBy("app").agg(total.alias("total_ms"), F.round(total / 3_600_000, 1).alias("hours"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("total_ms"), "app").limit(most)


def top_titles(acts: DataFrame, most: int = 5) -> DataFrame:
    """Each app's titles with most time; blank titles do not count."""
    rows = acts.where("title <> ''").groupBy("app", "title").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    place = F.row_number().over(Window.partitionBy("app").orderBy(F.desc("total_ms"), "title"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def span_stats(acts: DataFrame) -> DataFrame:
    """One row: how many activities, their first start and last end (null if there are none), and how many an hour."""
    hours = (F.max("end_ms") - F.min("start_ms")) / 3_600_000
    return acts.agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.round(F.when(hours > 0, F.count(F.lit(1)) / hours), 4).alias("per_hour"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, per_million: dict[str, tuple[float, float]]) -> Column:
    """What a call costs by a table of prices (in, out) for a million tokens; null for a model without a price, which a sum skips."""
    out = F.lit(None).cast("double")
    for name, (a, b) in per_million.items():
        out = F.when(model == name, tokens_in / 1_000_000 * a + tokens_out / 1_000_000 * b).otherwise(out)
    return out


def known_titles(labels: DataFrame, most: int = 40, least: int = 2) -> DataFrame:
    """(title, seen): labels seen often enough, the commonest first; of those that differ in case only the first stays."""
    seen = labels.select(F.trim("label").alias("title")).where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= least)
    first = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy(F.desc("seen"), "title"))
    return seen.withColumn("__r", first).where("__r = 1").drop("__r").orderBy(F.desc("seen"), "title").limit(most)


def content_queue(clusters: DataFrame, most: int = 20) -> DataFrame:
    """Clusters (id, label, n_steps, labeled_size, created, members) to name anew: two members at least, and no label, no steps, or twice the members it was named for."""
    stale = F.col("members") >= 2 * F.greatest(F.lit(1), F.coalesce("labeled_size", F.lit(0)))
    unnamed = (F.coalesce("label", F.lit("")) == "") | (F.coalesce("n_steps", F.lit(0)) == 0)
    return clusters.where((F.col("members") >= 2) & (unnamed | stale)).orderBy(F.desc("members"), "created", "id").limit(most)


def spaced(acts: DataFrame, most: int, key: str = "user_id") -> DataFrame:
    """Of each key's activities in time order the first, the last, and evenly spaced ones between, `most` in all; all where there are no more."""
    if most < 1:
        return acts.limit(0)
    w = Window.partitionBy(key)
    rows = acts.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy("start_ms", "id")) - 1)
    slots = max(most - 2, 0)
    step = (F.col("__n") - 3) / max(slots - 1, 1)
    chosen = [F.floor(i * step + 0.5) + 1 == F.col("__i") for i in range(slots)]
    hit = F.col("__i") == 0
    for c in [F.col("__i") == F.col("__n") - 1] * (most > 1) + chosen:
        hit = hit | c
    return rows.where((F.col("__n") <= most) | hit).drop("__n", "__i")


def chunk_counts(points: DataFrame, windows: DataFrame, key: str, chunk_ms: int, slot_ms: int) -> DataFrame:
    """(window, chunk_start, chunk_end, n): windows cut into chunks of at most chunk_ms, with their points; chunks without any are left out."""
    found = intervals.contained(points, windows, key, slot_ms)
    start = F.col("start_ms") + F.floor((F.col("t") - F.col("start_ms")) / chunk_ms) * chunk_ms
    rows = found.select("window", start.alias("chunk_start"), F.least("end_ms", start + chunk_ms - 1).alias("chunk_end"))
    return rows.groupBy("window", "chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("n"))


def attached(vectors: DataFrame, centroids: dict[int, list[float]], floor: float = 0.65) -> DataFrame:
    """(vec_id, centroid, sim): the centroid with the largest dot product, the smallest of ties; null where that is under the floor.

    A matrix product for each batch; more centroids than a block are taken block by block, and the best of the blocks' best is the best; then ids must be distinct. Vectors that are null, not finite or of another length have no centroid and no likeness.
    """
    named = sorted(centroids)
    blocks = [named[k : k + CENTROID_BLOCK] for k in range(0, len(named), CENTROID_BLOCK)] or [[]]
    if len(blocks) == 1:
        return _attached(vectors, centroids, named, floor)
    found = _attached(vectors, centroids, blocks[0], floor)
    for names in blocks[1:]:
        found = found.unionByName(_attached(vectors, centroids, names, floor))
    best = F.max_by("centroid", F.struct(F.coalesce("sim", F.lit(float("-inf"))), -F.coalesce("centroid", F.lit(0))))
    return found.groupBy("vec_id").agg(best.alias("centroid"), F.max("sim").alias("sim"))


def _attached(vectors: DataFrame, centroids: dict[int, list[float]], chosen: list[int], floor: float) -> DataFrame:
    names = np.array(chosen, np.int64)
    matrix = np.array([centroids[k] for k in chosen], np.float64) if chosen else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x if x is not None else [], np.float64) for x in batch.column(1).to_pylist()]
            fit = np.array([len(names) > 0 and len(x) == matrix.shape[1] and bool(np.isfinite(x).all()) for x in rows], bool)
            sims, best = np.full(len(rows), np.nan), np.zeros(len(rows), np.int64)
            if fit.any():
                s = np.stack([x for x, ok in zip(rows, fit, strict=True) if ok]) @ matrix.T
                sims[fit], best[fit] = s.max(1), names[s.argmax(1)]
            near = fit & (np.nan_to_num(sims, nan=-np.inf) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, mask=~near), pa.array(sims, mask=~fit)], ["vec_id", "centroid", "sim"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, centroid bigint, sim double")


def host_counts(visits: DataFrame, left_out: list[str], most: int = 200) -> DataFrame:
    """(host, n): the commonest hosts; null and empty ones do not count, nor those left out."""
    hosts = visits.where((F.col("host") != "") & ~F.col("host").isin(left_out)) if left_out else visits.where("host <> ''")
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(most)


def recent_sample(acts: DataFrame, keys: list[str], most: int = 15, detailed: int = 5) -> DataFrame:
    """The latest activities of each key, and whether one is among the first few, which are shown in detail."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start_ms"), F.desc("id")))
    return acts.withColumn("place", place).where(F.col("place") <= most).withColumn("detailed", F.col("place") <= detailed)
