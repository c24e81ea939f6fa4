"""Detected sets of activities scored against golden ones: recall, grounding, and what else was detected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZERO = ("positives", "found", "negatives", "rejected_again", "detections", "explained", "bundled", "rejects", "unreviewed", "grazes", "new", "cited", "cited_keep", "cited_reject")


def task_scores(golden: DataFrame, detected: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each fixture of golden (fixture, g, verdict, item) or detected (fixture, d, item), whose sets hold an item once, however often it is given.

    A golden set to keep is found if the detection that shares most with it (of ties the smallest) has the threshold's part of it; recall,
    precision and iou are means over those found, null if none is. Detections that explain none are counted once: as a reject reproduced, as an
    unreviewed set matched, as new if they share nothing with any golden set, else as a graze. rejected_again counts the rejected sets that
    some detection reproduces best (of ties the smallest), bundled the detections that explain several. Cited items of detections are in a set
    to keep, else in a rejected one, else unlabelled; id_precision is the part in sets to keep, null if none is cited.
    """
    gold, found_ = golden.select("fixture", "g", "verdict", "item").distinct(), detected.select("fixture", "d", "item").distinct()
    g_sizes = gold.groupBy("fixture", "g", "verdict").agg(F.count("item").alias("n_g"))
    d_sizes = found_.groupBy("fixture", "d").agg(F.count("item").alias("n_d"))
    shared = gold.join(found_, ["fixture", "item"]).groupBy("fixture", "g", "verdict", "d").agg(F.count(F.lit(1)).alias("n")).join(g_sizes, ["fixture", "g", "verdict"]).join(d_sizes, ["fixture", "d"])
    first = F.row_number().over(Window.partitionBy("fixture", "g").orderBy(F.desc("n"), "d"))
    best = shared.where("verdict = 'keep'").withColumn("r", first).where((F.col("r") == 1) & (F.col("n") >= threshold * F.col("n_g")))
    recall, precision, iou = F.col("n") / F.col("n_g"), F.col("n") / F.col("n_d"), F.col("n") / (F.col("n_g") + F.col("n_d") - F.col("n"))
    grounding = best.groupBy("fixture").agg(F.count(F.lit(1)).alias("found"), F.avg(recall).alias("recall_of_found"), F.avg(precision).alias("precision"), F.avg(iou).alias("iou"))
    explained = best.groupBy("fixture", "d").agg(F.count(F.lit(1)).alias("many"))
    explains = explained.groupBy("fixture").agg(F.count(F.lit(1)).alias("explained"), F.sum((F.col("many") > 1).cast("bigint")).alias("bundled"))

    ratio = F.col("n") / F.col("n_g")
    of = lambda verdict: F.max(F.when(F.col("verdict") == verdict, ratio))
    own = F.min(F.when(F.col("verdict") == "reject", F.struct((-ratio).alias("less"), F.col("g").alias("g"))))
    most = shared.groupBy("fixture", "d").agg(of("reject").alias("reject"), of("unreviewed").alias("unrev"), F.max(ratio).alias("any"), own.alias("own"))
    rest = d_sizes.join(explained, ["fixture", "d"], "left_anti").join(most, ["fixture", "d"], "left")
    kind = F.when(F.col("reject") >= threshold, "rejects").when(F.col("unrev") >= threshold, "unreviewed").when(F.col("any").isNull(), "new").otherwise("grazes")
    rest = rest.withColumn("kind", kind)
    counted = lambda name: F.sum((F.col("kind") == name).cast("bigint")).alias(name)
    buckets = rest.groupBy("fixture").agg(*map(counted, ("rejects", "unreviewed", "new", "grazes")), F.count_distinct(F.when(F.col("kind") == "rejects", F.col("own.g"))).alias("rejected_again"))

    labels = gold.groupBy("fixture", "item").agg(F.max((F.col("verdict") == "keep").cast("int")).alias("keep"), F.max((F.col("verdict") == "reject").cast("int")).alias("reject"))
    cited = found_.where("item is not null").join(labels, ["fixture", "item"], "left")
    keep = F.coalesce(F.col("keep") == 1, F.lit(False))
    ids = cited.groupBy("fixture").agg(F.count(F.lit(1)).alias("cited"), F.sum(keep.cast("bigint")).alias("cited_keep"), F.sum((~keep & F.coalesce(F.col("reject") == 1, F.lit(False))).cast("bigint")).alias("cited_reject"))

    sets = g_sizes.groupBy("fixture").agg(*(F.sum((F.col("verdict") == v).cast("bigint")).alias(name) for v, name in (("keep", "positives"), ("reject", "negatives"))))
    out = sets.join(d_sizes.groupBy("fixture").agg(F.count(F.lit(1)).alias("detections")), "fixture", "full_outer")
    for part in (grounding, explains, buckets, ids):
        out = out.join(part, "fixture", "left")
    out = out.select("fixture", *(F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ZERO), "recall_of_found", "precision", "iou")
    part = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    means = [F.round(x, 6).alias(x) for x in ("recall_of_found", "precision", "iou")]
    return out.select("fixture", *ZERO, F.coalesce(part("found", "positives"), F.lit(0.0)).alias("recall"), part("cited_keep", "cited").alias("id_precision"), *means)


def mean_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column over the rows where it isn't null (null if there is none), and the number of rows."""
    return scores.agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.avg(c), 6).alias(c) for c in columns))
