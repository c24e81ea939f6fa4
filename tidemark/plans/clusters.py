"""Queries of the store of clusters over the driver's tables, and their SQL. A user is a cluster, activities are its sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clusters, intervals
from tidemark.plans.queries import _ACTS, _SIDES, _acts, _sides
from tidemark.sources.tables import table


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Clusters, memberships, signatures and the sightings that are left: errors are gone, and so are clicks of every third user."""
    acts = _acts(spark, d)
    own = acts.groupBy(F.col("user_id").alias("cluster")).agg(F.min("start_ms").alias("created_ms")).withColumn("label", F.when(F.col("cluster") % 2 == 0, F.concat(F.lit("user "), F.col("cluster"))))
    left = acts.where("app <> 'error' and not (user_id % 3 = 0) or app = 'signup' and user_id % 2 = 0")
    return own, acts.select(F.col("user_id").alias("cluster"), "id"), acts.where("title <> ''").select("id"), left


def member_digest(spark: SparkSession, d: str) -> DataFrame:
    _, memberships, _, left = _parts(spark, d)
    return clusters.digest(memberships, left).select("cluster", "id", "title", "start_ms", "place")


def recurring_labels(spark: SparkSession, d: str) -> DataFrame:
    own, memberships, _, _ = _parts(spark, d)
    return clusters.recurring_labels(own, memberships)


def pruned_counts(spark: SparkSession, d: str) -> DataFrame:
    p = clusters.pruned(*_parts(spark, d))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(p.memberships, "memberships").join(count(p.signatures, "signatures")).join(count(p.clusters, "clusters")).join(count(p.touched, "touched"))  # one row each


def cited_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite the parts of all their lines, the last first; known are those of lines that nobody sent back."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("id"), "l_linenumber", "l_returnflag")
    told = lines.groupBy("o").agg(F.reverse(F.array_sort(F.collect_list(F.struct("l_linenumber", "id")))).alias("l")).select("o", F.col("l.id").alias("ids"))
    return clusters.cited(told, lines.where("l_returnflag = 'N'"), ["o"]).select("o", F.array_join("ids", ",").alias("ids"))


def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_suppkey", F.array("l_returnflag").alias("flags"), F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("lines"))
    out = clusters.merged_lists(parts, ["l_suppkey"], ["flags", "lines"])
    return out.select("l_suppkey", F.array_join("flags", ",").alias("flags"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def id_aliases(spark: SparkSession, d: str) -> DataFrame:
    return clusters.aliases(_acts(spark, d), ["user_id"], ["start_ms", "app"], "title").select("user_id", "title", "alias")


def as_of_forward(spark: SparkSession, d: str) -> DataFrame:
    return intervals.as_of(*_sides(spark, d), "user_id", "forward")


_LEFT = f"{_ACTS}, lf AS (SELECT * FROM acts WHERE (app <> 'error' AND NOT (user_id % 3 = 0)) OR (app = 'signup' AND user_id % 2 = 0))"
SQL = {
    "member_digest": f"WITH {_LEFT} SELECT user_id AS cluster, id, title, start_ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_ms, id) AS INT) AS place FROM lf",
    "recurring_labels": "SELECT user_id AS cluster, 'user ' || user_id AS label, count(*) AS seen FROM events WHERE user_id % 2 = 0 GROUP BY user_id HAVING count(*) >= 2",
    "pruned_counts": f"WITH {_LEFT} SELECT (SELECT count(*) FROM lf) AS memberships, (SELECT count(*) FROM lf WHERE title <> '') AS signatures, (SELECT count(DISTINCT user_id) FROM lf) AS clusters, (SELECT count(DISTINCT user_id) FROM acts a WHERE NOT EXISTS (SELECT 1 FROM lf WHERE lf.id = a.id) AND EXISTS (SELECT 1 FROM lf WHERE lf.user_id = a.user_id)) AS touched",
    "cited_lines": "WITH k AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS id FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT l_orderkey AS o, l_partkey AS id, max(l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT o, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n DESC, id DESC) AS ids FROM c JOIN k USING (o, id) GROUP BY o",
    "merged_lists": "WITH f AS (SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1), n AS (SELECT DISTINCT l_suppkey, unnest([l_linenumber, l_linenumber + 1]) AS x FROM lineitem), l AS (SELECT l_suppkey, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS lines FROM n GROUP BY 1) SELECT * FROM f JOIN l USING (l_suppkey)",
    "id_aliases": f"WITH {_ACTS}, m AS (SELECT user_id, title, min((start_ms, app)) AS f FROM acts GROUP BY ALL) SELECT user_id, title, 'a' || row_number() OVER (PARTITION BY user_id ORDER BY f, title) AS alias FROM m",
    "as_of_forward": f"WITH {_ACTS}, {_SIDES} SELECT user_id, t, a AS match FROM m",
}
QUERIES = {name: globals()[name] for name in SQL}
