"""The pattern view, listings without a query, threshold sweeps and scrubbed texts over the driver's tables, with SQL where it can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scrub
from tidemark.operators import patterns, views
from tidemark.plans.queries import _ACTS, NOW, _acts
from tidemark.sources.tables import table

KEY = ["user_id", "app"]


def _view(spark: SparkSession, d: str) -> DataFrame:
    """Clusters are a user's activities of one app; every fifth user's have a label. An activity with a title above 4 tells its steps."""
    told = F.when(F.col("title") > "4", F.array(F.lit("open"), F.concat(F.lit("do "), F.col("title")))).otherwise(F.array().cast("array<string>"))
    acts = _acts(spark, d).withColumn("steps", told).withColumn("active_ms", F.col("end_ms") - F.col("start_ms"))
    label = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(" Work on "), F.col("app")))
    clusters = acts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).select(*KEY, label.alias("label"), F.array().cast("array<string>").alias("steps"))
    return views.clusters_view(clusters, acts, KEY, NOW, 14)


def clusters_view(spark: SparkSession, d: str) -> DataFrame:
    rows = views.listed(_view(spark, d), ["user_id"])
    return rows.select("user_id", "app", "title", F.array_join("steps", "|").alias("steps"), "seen", "mean_ms", "last_ms", "hidden", "rank")


def searched_patterns(spark: SparkSession, d: str) -> DataFrame:
    return views.searched(_view(spark, d), "ON CLI").select("user_id", "app", "title", "seen")


def recent_listing(spark: SparkSession, d: str) -> DataFrame:
    return views.recent_first(_acts(spark, d), 7).select("user_id", "id", "of", "place")


def label_sweep(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.round(F.length("text") / 100).alias("score"))
    return patterns.threshold_sweep(table(spark, d, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 1).alias("positive")), 10.0)


def scrubbed_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.size(scrub.claims(F.col("text"))).cast("bigint").alias("n_claims"))
    return rows.select("conv_id", "turn", "n_claims", F.md5(F.when(F.col("n_claims") > 0, scrub.scrubbed(F.col("text"))).otherwise(F.col("text"))).alias("text_md5"))


_VIEW = f"""{_ACTS}, m AS (SELECT *, trim(title) AS t, end_ms - start_ms AS active_ms, CASE WHEN title > '4' THEN 'open|do ' || title ELSE '' END AS steps FROM acts WHERE start_ms > {NOW - 14 * 86_400_000} AND start_ms <= {NOW}),
 st AS (SELECT user_id, app, count(*) AS seen, CAST(sum(active_ms) AS BIGINT) AS total_ms, max(start_ms) AS last_ms FROM m GROUP BY ALL),
 ti AS (SELECT user_id, app, t, count(*) AS n, min((start_ms, id)) AS f FROM m WHERE t <> '' GROUP BY ALL), mo AS (SELECT user_id, app, t AS modal FROM ti QUALIFY row_number() OVER (PARTITION BY user_id, app ORDER BY n DESC, f) = 1),
 ow AS (SELECT m.user_id, m.app, steps FROM m LEFT JOIN mo USING (user_id, app) WHERE steps <> '' QUALIFY row_number() OVER (PARTITION BY m.user_id, m.app ORDER BY (t = coalesce(modal, '')) DESC, start_ms DESC, id DESC) = 1),
 v AS (SELECT user_id, app, CASE WHEN user_id % 5 = 0 THEN 'Work on ' || app ELSE coalesce(modal, 'Untitled task') END AS title, coalesce(steps, '') AS steps, seen, total_ms // seen AS mean_ms, last_ms, seen < 2 AND total_ms < 1800000 AS noise FROM st LEFT JOIN mo USING (user_id, app) LEFT JOIN ow USING (user_id, app))"""
SQL = {
    "clusters_view": f"WITH {_VIEW}, h AS (SELECT *, count(*) FILTER (noise) OVER (PARTITION BY user_id) AS hidden FROM v) SELECT user_id, app, title, steps, seen, mean_ms, last_ms, hidden, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, last_ms DESC, title) AS INT) AS rank FROM h WHERE NOT noise",
    "searched_patterns": f"WITH {_VIEW} SELECT user_id, app, title, seen FROM v WHERE NOT noise AND (contains(lower(title), 'on cli') OR contains(lower(steps), 'on cli') OR contains(lower(app), 'on cli'))",
    "recent_listing": f"WITH {_ACTS}, r AS (SELECT user_id, id, count(*) OVER (PARTITION BY user_id) AS of_, row_number() OVER (PARTITION BY user_id ORDER BY start_ms DESC, id DESC) AS back FROM acts) SELECT user_id, id, of_ AS of, CAST(least(of_, 7) + 1 - back AS INT) AS place FROM r WHERE back <= 7",
    "label_sweep": """WITH d AS (SELECT round(length(text) / 100) AS score, quality = 1 AS pos FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), t AS (SELECT DISTINCT score AS s FROM d),
 f AS (SELECT s, count(*) FILTER (pos AND score >= s) AS tp, count(*) FILTER (NOT pos AND score >= s) AS fp, count(*) FILTER (pos AND score < s) AS fn FROM t, d GROUP BY s), g AS (SELECT s, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f),
 b AS (SELECT s, f1 FROM g ORDER BY round(f1, 9) DESC, s LIMIT 1), x AS (SELECT f1 FROM g WHERE s >= 10 ORDER BY s LIMIT 1)
 SELECT s AS best_score, round(f1, 6) AS best_f1, round(coalesce((SELECT f1 FROM x), 0), 6) AS f1_fixed, round((SELECT avg(score) FROM d WHERE pos), 6) AS pos_mean, round((SELECT avg(score) FROM d WHERE NOT pos), 6) AS neg_mean FROM b""",
}
QUERIES = {name: globals()[name] for name in ("scrubbed_turns", *SQL)}
