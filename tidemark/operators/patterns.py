"""Recurring patterns: active days, statistics, modal titles, recurrence histograms, trends, near duplicates, scores against golden data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import DAY_MS, day_of
from tidemark.sources.tables import kept


def app_totals(acts: DataFrame, limit: int = 100) -> DataFrame:
    """Count, last end and days of each app, the commonest first; the limit is held to 1..100."""
    days = F.count_distinct(day_of(F.col("start_ms")))
    rows = acts.groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.max("end_ms").alias("last_ms"), days.alias("days"))
    return rows.orderBy(F.desc("n"), F.desc("last_ms"), "app").limit(min(100, max(1, limit)))


def pattern_stats(acts: DataFrame, observed_days: int, now_ms: int, least_seen: int = 2, least_ms: int = 1_800_000) -> DataFrame:
    """Times seen, mean and total milliseconds, runs a week and last sight of each (user, app) within the window; seldom and short ones are noise."""
    rows = acts.where((F.col("start_ms") >= now_ms - observed_days * DAY_MS) & (F.col("start_ms") <= now_ms))
    out = rows.groupBy("user_id", "app").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.max("start_ms").alias("last_ms"))
    out = out.withColumn("mean_ms", F.floor(F.col("total_ms") / F.col("seen"))).withColumn("per_week", F.round(F.col("seen") * 7.0 / observed_days, 4))
    return out.withColumn("noise", (F.col("seen") < least_seen) & (F.col("total_ms") < least_ms))


def modal_title(acts: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest trimmed title that isn't empty; of ties the one that occurred first."""
    rows = acts.withColumn("title", F.trim("title")).where("title != ''").groupBy(*keys, "title").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_ms", "id")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "title", "n")


def recurrence(acts: DataFrame, keys: list[str], most: int = 24) -> DataFrame:
    """Zero-filled histogram of the last `most` buckets: days if the span is under 24 days, else weeks from Monday."""
    days = acts.select(*keys, day_of(F.col("start_ms")).alias("d"))
    span = days.groupBy(*keys).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("unit", F.when(F.col("hi") - F.col("lo") < 24, 1).otherwise(7))
    bucket = lambda d: F.when(F.col("unit") == 1, d).otherwise(F.floor((d + 3) / 7) * 7 - 3)  # noqa: E731  day 0 was a Thursday
    last = bucket(F.col("hi"))
    spine = span.select(*keys, "unit", F.explode(F.sequence(F.greatest(bucket(F.col("lo")), last - (most - 1) * F.col("unit")), last, F.col("unit").cast("bigint"))).alias("bucket"))
    counts = days.join(span, keys).select(*keys, bucket(F.col("d")).alias("bucket")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))
    return spine.join(counts, [*keys, "bucket"], "left").select(*keys, "unit", "bucket", F.coalesce("c", F.lit(0)).alias("n"))


def close_repeats(acts: DataFrame, within_ms: int = 600_000) -> DataFrame:
    """How many earlier activities of the same user, app and title began at most within_ms before: a range frame, no pairs."""
    w = Window.partitionBy("user_id", "app", "title").orderBy("start_ms").rangeBetween(-within_ms, 0)
    same = Window.partitionBy("user_id", "app", "title", "start_ms")
    return acts.select("id", (F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(same)).alias("earlier"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, mean): unit-length mean vector of each label. Sums of a dimension are combined before they are shuffled."""
    rows = vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    mean = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v")).select("label", F.col("v.m").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("norm", norm).where("norm > 0").select("label", F.transform("v", lambda x: x / F.col("norm")).alias("mean"))


def coherence(vectors: DataFrame) -> DataFrame:
    """Mean cosine of a label's members to its centroid, and the number of members. Each vector is one row, multiplied by one of the centroids."""
    rows = vectors.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("x")).join(centroids(vectors), "label")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    cos = total(F.zip_with("x", "mean", lambda a, b: a * b)) / F.sqrt(total(F.transform("x", lambda v: v * v)))
    return rows.select("label", cos.alias("c")).groupBy("label").agg(F.round(F.avg("c"), 5).alias("coherence"), F.count(F.lit(1)).alias("members"))


def score_counts(scored: DataFrame) -> DataFrame:
    """(score, p, q, p_below, q_below): positives and negatives of each score of (score, positive), and of all smaller ones.

    Scores are dealt by ranges; running counts go within a range, and the totals of the ranges before it, one row each, are added.
    """
    s = scored.where("score is not null and positive is not null").groupBy("score").agg(F.sum(F.col("positive").cast("bigint")).alias("p"), F.sum((~F.col("positive")).cast("bigint")).alias("q"))
    s = kept(s.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = s.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).select("part", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("tq").over(before), F.lit(0)).alias("bq"))
    own = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = s.withColumn("op", F.coalesce(F.sum("p").over(own), F.lit(0))).withColumn("oq", F.coalesce(F.sum("q").over(own), F.lit(0))).join(parts, "part")
    return rows.select("score", "p", "q", (F.col("op") + F.col("bp")).alias("p_below"), (F.col("oq") + F.col("bq")).alias("q_below"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of (score, positive): by counts of equal scores, so no pair is formed."""
    won = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2.0))
    return score_counts(scored).agg(F.round(won / (F.sum("p") * F.sum("q")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def threshold_sweep(scored: DataFrame, fixed: float) -> DataFrame:
    """One row: the score that gives the best F1 if all at it or above count as positive (of ties the smallest), that F1, the F1 at a fixed score, and the mean scores of positives and negatives."""
    counts = score_counts(scored)
    total = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("all_p"), F.sum("q").alias("all_q"), (F.sum(F.col("score") * F.col("p")) / F.sum("p")).alias("pos_mean"), (F.sum(F.col("score") * F.col("q")) / F.sum("q")).alias("neg_mean"))
    rows = counts.join(F.broadcast(total))  # one row
    hit, wrong = F.col("all_p") - F.col("p_below"), F.col("all_q") - F.col("q_below")
    f1 = F.when(hit > 0, 2 * hit / (2 * hit + wrong + F.col("p_below"))).otherwise(0.0)
    best = F.min(F.struct((-F.round(f1, 9)).alias("less"), F.col("score").alias("score")))
    at = F.min_by(f1, F.when(F.col("score") >= fixed, F.col("score")))
    out = rows.agg(best.alias("b"), F.coalesce(at, F.lit(0.0)).alias("f1_fixed"), F.first("pos_mean").alias("pos_mean"), F.first("neg_mean").alias("neg_mean"), F.max("score").alias("top"))
    return out.select(F.col("b.score").alias("best_score"), F.round(-F.col("b.less"), 6).alias("best_f1"), F.round(F.when(F.col("top") >= fixed, F.col("f1_fixed")).otherwise(0.0), 6).alias("f1_fixed"), F.round("pos_mean", 6).alias("pos_mean"), F.round("neg_mean", 6).alias("neg_mean"))
