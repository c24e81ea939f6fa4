"""Queries of members, trends and text rules, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import membership, trends
from tidemark.plans.queries import _ACTS, NOW, _acts
from tidemark.sources.tables import table


def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return membership.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def owned_labels(spark: SparkSession, d: str) -> DataFrame:
    return membership.pruned(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id").select("doc_id", "quality")


def recurring_groups(spark: SparkSession, d: str) -> DataFrame:
    return membership.recurring(table(spark, d, "embeddings"), "label")


def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias(name), F.col("l_partkey").alias("item"))
    return membership.best_overlap(side("R", "g"), side("A", "d"))


def arm_changes(spark: SparkSession, d: str) -> DataFrame:
    side = lambda app: _acts(spark, d).where(F.col("app") == app).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return membership.arms(side("view"), side("purchase"), "user_id", "n")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return trends.count_by(_acts(spark, d), "app", ["click", "error", "refund"])


def weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return trends.weekly_counts(_acts(spark, d), NOW)


def user_spread(spark: SparkSession, d: str) -> DataFrame:
    return trends.spread(_acts(spark, d), ["user_id"])


def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return trends.run_lengths(_acts(spark, d), "app")


def focus_changes(spark: SparkSession, d: str) -> DataFrame:
    return trends.changes_only(_acts(spark, d), ["app"]).select("id", "user_id", "app")


def ungated(spark: SparkSession, d: str) -> DataFrame:
    return trends.gated(_acts(spark, d), F.col("app") == "view", F.col("end_ms") - F.col("start_ms") > 50_000).select("id")


def first_purchase_scores(spark: SparkSession, d: str) -> DataFrame:
    acts = _acts(spark, d)
    earlier = acts.where("app = 'purchase'").groupBy("user_id").agg(F.min(F.struct("start_ms", "id")).alias("first"))
    ranks = acts.join(earlier, "user_id", "left").groupBy("user_id").agg(F.max("first").alias("first"), F.count(F.when(F.struct("start_ms", "id") <= F.col("first"), 1)).alias("n"))
    return trends.retrieval_scores(ranks.select("user_id", F.when(F.col("first").isNotNull(), F.col("n")).alias("rank")))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return trends.stratified(_acts(spark, d), "app", "id", 100, 7).select("id", "app", "turn")


def plain_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.plain_title(F.col("text"))).alias("title_md5"))


def order_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(text.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def quarter_hours(spark: SparkSession, d: str) -> DataFrame:
    return _acts(spark, d).groupBy("user_id").agg(text.quarter_hours(F.sum(F.col("end_ms") - F.col("start_ms")) / 60000).alias("hours"))


def luhn_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(text.passes_luhn(F.col("o_orderkey").cast("string"))).select("o_orderkey")


def keyword_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(text.mentions("EC", F.col("p_name"), F.col("p_type"))).select("p_partkey")


_TIME = "(PARTITION BY user_id ORDER BY start_ms, id)"
_RUN = f"f AS (SELECT *, CASE WHEN lag(id) OVER {_TIME} IS NOT NULL AND lag(app) OVER {_TIME} IS NOT DISTINCT FROM app THEN 0 ELSE 1 END AS f FROM acts)"
_WEEK = "(start_ms // 86400000 + 3) // 7"
_LAST = (NOW // 86_400_000 + 3) // 7

SQL = {
    "unlabelled": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "owned_labels": "SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)",
    "recurring_groups": "SELECT label, count(*) AS members FROM embeddings GROUP BY label HAVING count(*) >= 2",
    "best_overlap": """WITH l AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A'),
 s AS (SELECT g, d, count(*) AS shared FROM l JOIN r USING (item) GROUP BY g, d), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY shared DESC, d) = 1),
 n AS (SELECT g, count(*) AS ng FROM l GROUP BY g), m AS (SELECT d, count(*) AS nd FROM r GROUP BY d)
 SELECT g, d, shared, round(shared / ng, 6) AS recall, round(shared / nd, 6) AS precision, round(shared / (ng + nd - shared), 6) AS iou FROM b JOIN n USING (g) JOIN m USING (d)""",
    "arm_changes": f"WITH {_ACTS}, a AS (SELECT user_id, count(*) AS a FROM acts WHERE app = 'view' GROUP BY user_id), b AS (SELECT user_id, count(*) AS b FROM acts WHERE app = 'purchase' GROUP BY user_id) SELECT user_id, a, b, b - a AS change FROM a FULL JOIN b USING (user_id)",
    "status_counts": "SELECT app, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('refund')) s(app) LEFT JOIN events ON event_type = app GROUP BY app",
    "weekly_counts": f"WITH {_ACTS} SELECT week * 7 - 3 AS monday, count(id) AS n FROM range({_LAST - 3}, {_LAST + 1}) g(week) LEFT JOIN acts ON {_WEEK} = week GROUP BY week",
    "user_spread": f"WITH {_ACTS} SELECT user_id, median(end_ms - start_ms) AS median_ms, (max(start_ms) - min(start_ms)) // 86400000 + 1 AS span_days FROM acts GROUP BY user_id",
    "run_lengths": f"WITH {_ACTS}, {_RUN}, r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY start_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f) SELECT user_id, run, app, count(*) AS n FROM r GROUP BY user_id, run, app",
    "focus_changes": f"WITH {_ACTS}, {_RUN} SELECT id, user_id, app FROM f WHERE f = 1",
    "ungated": f"WITH {_ACTS}, s AS (SELECT id, last_value(CASE WHEN app = 'view' THEN end_ms - start_ms > 50000 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blocked FROM acts) SELECT id FROM s WHERE NOT coalesce(blocked, false)",
    "first_purchase_scores": f"WITH {_ACTS}, n AS (SELECT user_id, app, row_number() OVER {_TIME} AS i FROM acts), r AS (SELECT user_id, min(i) FILTER (app = 'purchase') AS rank FROM n GROUP BY user_id) SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr10, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, count(*) AS queries FROM r",
    "stratified_sample": f"WITH {_ACTS}, t AS (SELECT id, app, CAST(row_number() OVER (PARTITION BY app ORDER BY md5('7:' || id), id) AS INT) AS turn FROM acts) SELECT id, app, turn FROM t ORDER BY turn, app LIMIT 100",
    "plain_titles": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\p{So}\p{Sk}\x{FE0F}\x{200D}]', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS title_md5 FROM documents",
    "order_pairs": "SELECT concat(least(l_partkey, l_suppkey), '|', greatest(l_partkey, l_suppkey)) AS pair, count(*) AS n FROM lineitem GROUP BY pair",
    "quarter_hours": f"WITH {_ACTS} SELECT user_id, greatest(1, floor(sum(end_ms - start_ms) / 60000 / 15 + 0.5)) / 4 AS hours FROM acts GROUP BY user_id",
    "luhn_orders": "WITH d AS (SELECT o_orderkey, unnest(range(1, len(k) + 1)) AS i, unnest([CAST(x AS INT) FOR x IN string_split(reverse(k), '')]) AS v FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)) SELECT o_orderkey FROM d GROUP BY o_orderkey HAVING sum(CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) % 10 = 0",
    "keyword_parts": "SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '')), 'ec') OR contains(lower(coalesce(p_type, '')), 'ec')",
}
QUERIES = {name: globals()[name] for name in SQL}
