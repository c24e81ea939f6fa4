"""Queries of profiles, ledgers, exclusions and review queues, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels, web
from tidemark.operators import exclusions, ledger, membership, profile, timeline
from tidemark.plans.queries import _ACTS, JAN_10, NOW, _acts
from tidemark.sources.tables import table

EXCLUDED = ["example.net", "*/es/*utm_*"]
PRICES = {"user": (0.25, 1.0), "assistant": (0.5, 2.0)}


def app_hours(spark: SparkSession, d: str) -> DataFrame:
    return profile.app_hours(_acts(spark, d))


def top_titles(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_titles(_acts(spark, d))


def span_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.span_stats(_acts(spark, d))


def excluded_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", exclusions.excluded_by(F.col("url"), EXCLUDED).alias("pattern")).where("pattern is not null")


def missing_days(spark: SparkSession, d: str) -> DataFrame:
    acts = _acts(spark, d)
    done = acts.where("app = 'signup' AND user_id = 12").select(timeline.day_of(F.col("start_ms")).alias("day"))
    return ledger.missing_days(acts, done, NOW)


def delta_rows(spark: SparkSession, d: str) -> DataFrame:
    return ledger.delta(_acts(spark, d), JAN_10).select("id", "start_ms", "end_ms")


def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_acts(spark, d), ["user_id", "app"], ["start_ms", "id"])


def conversation_costs(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    c = profile.cost(F.col("role"), n, F.col("turn"), PRICES)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.sum(c), 8).alias("usd"))


def known_titles(spark: SparkSession, d: str) -> DataFrame:
    return profile.known_titles(_acts(spark, d).select(F.when(F.col("id") % 2 == 0, F.upper("app")).otherwise(F.col("app")).alias("label")))


def content_queue(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 4).alias("n_steps"), F.col("c_nationkey").alias("labeled_size"), F.col("c_custkey").alias("created"))
    return profile.content_queue(named.join(members, "id")).select("id", "members")


def spaced_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.spaced(_acts(spark, d), 6).select("id", "user_id")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    a = _acts(spark, d)
    points = a.where("app = 'click'").select("user_id", F.col("start_ms").alias("t"), "id")
    windows = a.where("app = 'view'").select("user_id", "start_ms", "end_ms", F.col("id").alias("window"))
    return profile.chunk_counts(points, windows, "user_id", 30_000, 600_000)


def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    first = vectors.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).collect()
    found = profile.attached(vectors, {r.label: r.e for r in first}, 0.3)
    return found.select("vec_id", "centroid", F.round("sim", 4).alias("sim"))


def around_noon(spark: SparkSession, d: str) -> DataFrame:
    return timeline.around(_acts(spark, d), JAN_10 + 43_200_000, 900).select("id", "start_ms")


def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    return _acts(spark, d).select("id", labels.duration_text((F.col("end_ms") - F.col("start_ms")) * 20).alias("lasted"))


def document_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = labels.step_list(F.split("text", r"\."))
    return table(spark, d, "documents").select("doc_id", F.size(steps).cast("bigint").alias("n"), F.md5(F.array_join(steps, "|")).alias("steps_md5"))


def part_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", labels.signature_text(F.col("p_name"), F.col("p_type")).alias("signature"))


def viewed_labels(spark: SparkSession, d: str) -> DataFrame:
    short = _acts(spark, d).where("app = 'view' AND end_ms - start_ms < 60000")
    return short.select("id", labels.viewed_label(F.when(F.col("id") % 3 > 0, F.col("title")), F.lit(" "), F.col("app")).alias("label"))


def arm_differences(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return membership.differing(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_suppkey", "l_partkey"])


def resolved_totals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    found = membership.resolved_totals(table(spark, d, "lineitem"), orders, "l_partkey", "l_orderkey", "o_totalprice")
    return found.select("l_partkey", F.round("total", 2).alias("total"))


def review_order(spark: SparkSession, d: str) -> DataFrame:
    side = lambda app: _acts(spark, d).where(F.col("app") == app).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return membership.review_first(membership.arms(side("view"), side("purchase"), "user_id", "n"), F.col("a") > 100, 3).select("user_id", "change")


def common_hosts(spark: SparkSession, d: str) -> DataFrame:
    return profile.host_counts(table(spark, d, "pages").select(web.host(F.col("url")).alias("host")), ["localhost"])


def recent_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.recent_sample(_acts(spark, d), ["user_id"]).select("id", "place", "detailed")


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return timeline.audited(_acts(spark, d), "click", "7").select("id", "title")


def day_apps(spark: SparkSession, d: str) -> DataFrame:
    runs = _acts(spark, d).groupBy("user_id", timeline.day_of(F.col("start_ms")).alias("day")).agg(F.array_sort(F.collect_set("app")).alias("apps"))
    return runs.select("user_id", "day", F.array_join(labels.run_apps(F.col("apps"), ["click", "view"]), "|").alias("apps"))


_N = "(end_ms - start_ms) * 20 // 1000"
_DOT = "list_sum([CAST(e.embedding[i] AS DOUBLE) * CAST(c.e[i] AS DOUBLE) FOR i IN range(1, len(c.e) + 1)])"

SQL = {
    "app_hours": f"WITH {_ACTS} SELECT app, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, round(sum(end_ms - start_ms) / 3600000, 1) AS hours, count(*) AS n FROM acts GROUP BY app ORDER BY total_ms DESC, app LIMIT 15",
    "top_titles": f"WITH {_ACTS}, t AS (SELECT app, title, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM acts WHERE title <> '' GROUP BY app, title) SELECT *, CAST(row_number() OVER (PARTITION BY app ORDER BY total_ms DESC, title) AS INT) AS place FROM t QUALIFY place <= 5",
    "span_stats": f"WITH {_ACTS} SELECT count(*) AS n, min(start_ms) AS first_ms, max(end_ms) AS last_ms, round(count(*) / ((max(end_ms) - min(start_ms)) / 3600000), 4) AS per_hour FROM acts",
    "excluded_pages": r"WITH h AS (SELECT page_id, lower(url) AS u, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1), ':[0-9]+$', '') AS h FROM pages), p AS (SELECT page_id, CASE WHEN h = 'example.net' OR suffix(h, '.example.net') THEN 'example.net' WHEN regexp_matches(u, '/es/.*utm_') THEN '*/es/*utm_*' END AS pattern FROM h) SELECT * FROM p WHERE pattern IS NOT NULL",
    "missing_days": f"WITH {_ACTS} SELECT day FROM range({NOW // 86400000 - 60}, {NOW // 86400000}) g(day) WHERE (day + 1) * 86400000 - 1 >= (SELECT min(start_ms) FROM acts) AND day NOT IN (SELECT start_ms // 86400000 FROM acts WHERE app = 'signup' AND user_id = 12)",
    "delta_rows": f"WITH {_ACTS} SELECT id, start_ms, end_ms FROM acts WHERE end_ms >= {JAN_10 - 3600000}",
    "latest_rows": f"WITH {_ACTS} SELECT * FROM acts QUALIFY row_number() OVER (PARTITION BY user_id, app ORDER BY start_ms DESC, id DESC) = 1",
    "conversation_costs": "SELECT conv_id, round(sum(CASE role WHEN 'user' THEN length(text) / 1000000 * CAST(0.25 AS DOUBLE) + turn / 1000000 * CAST(1 AS DOUBLE) WHEN 'assistant' THEN length(text) / 1000000 * CAST(0.5 AS DOUBLE) + turn / 1000000 * CAST(2 AS DOUBLE) END), 8) AS usd FROM conversations GROUP BY conv_id",
    "known_titles": f"WITH {_ACTS}, s AS (SELECT trim(CASE WHEN id % 2 = 0 THEN upper(app) ELSE app END) AS title, count(*) AS seen FROM acts GROUP BY 1 HAVING count(*) >= 2) SELECT title, seen FROM s WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY seen DESC, title) = 1 ORDER BY seen DESC, title LIMIT 40",
    "content_queue": "WITH m AS (SELECT o_custkey AS id, count(*) AS members FROM orders GROUP BY 1) SELECT id, members FROM m JOIN customer ON id = c_custkey WHERE members >= 2 AND (coalesce(c_mktsegment, '') = '' OR c_custkey % 4 = 0 OR members >= 2 * greatest(1, coalesce(c_nationkey, 0))) ORDER BY members DESC, id LIMIT 20",
    "spaced_rows": f"WITH {_ACTS}, r AS (SELECT id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, id) - 1 AS i FROM acts) SELECT id, user_id FROM r WHERE n <= 6 OR i IN (0, n - 1) OR i IN (SELECT CAST(floor(k * (n - 3) / 3 + 0.5) AS BIGINT) + 1 FROM range(4) g(k))",
    "chunk_counts": f"WITH {_ACTS}, f AS (SELECT w.id AS \"window\", w.start_ms + (p.start_ms - w.start_ms) // 30000 * 30000 AS chunk_start, w.end_ms FROM acts p JOIN acts w ON p.user_id = w.user_id AND p.start_ms BETWEEN w.start_ms AND w.end_ms WHERE p.app = 'click' AND w.app = 'view') SELECT \"window\", chunk_start, least(end_ms, chunk_start + 29999) AS chunk_end, count(*) AS n FROM f GROUP BY ALL",
    "attached_vectors": f"WITH c AS (SELECT CAST(label AS BIGINT) AS label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label), s AS (SELECT vec_id, c.label, {_DOT} AS sim FROM embeddings e, c) SELECT vec_id, CASE WHEN sim >= 0.3 THEN label END AS centroid, round(sim, 4) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1",
    "around_noon": f"WITH {_ACTS} SELECT id, start_ms FROM acts WHERE end_ms >= {JAN_10} AND start_ms <= {JAN_10 + 86399999}",
    "duration_texts": f"WITH {_ACTS}, s AS (SELECT id, {_N} AS s FROM acts) SELECT id, (CASE WHEN s >= 3600 THEN s // 3600 || 'h ' ELSE '' END) || (CASE WHEN s >= 60 THEN s % 3600 // 60 || 'm ' ELSE '' END) || s % 60 || 's' AS lasted FROM s",
    "document_steps": r"WITH s AS (SELECT doc_id, list_filter([substring(regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), 1, 200) FOR x IN string_split(coalesce(text, ''), '.')], lambda x: x <> '')[1:15] AS s FROM documents) SELECT doc_id, len(s) AS n, md5(coalesce(array_to_string(s, '|'), '')) AS steps_md5 FROM s",
    "part_signatures": "SELECT p_partkey, concat_ws('. ', nullif(trim(p_name), ''), nullif(trim(p_type), '')) AS signature FROM part",
    "viewed_labels": f"WITH {_ACTS} SELECT id, 'Viewed ' || coalesce(nullif(trim(CASE WHEN id % 3 > 0 THEN title END), ''), app) AS label FROM acts WHERE app = 'view' AND end_ms - start_ms < 60000",
    "arm_differences": "WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') SELECT *, 'a' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'b' FROM (SELECT * FROM a EXCEPT SELECT * FROM r)",
    "resolved_totals": "WITH m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P') SELECT l_partkey, round(sum(o_totalprice), 2) AS total FROM m LEFT JOIN o ON o_orderkey = l_orderkey GROUP BY l_partkey HAVING count(*) = count(o_orderkey)",
    "review_order": f"WITH {_ACTS}, s AS (SELECT user_id, nullif(count(*) FILTER (app = 'view'), 0) AS a, nullif(count(*) FILTER (app = 'purchase'), 0) AS b FROM acts GROUP BY user_id) SELECT user_id, b - a AS change FROM s WHERE a > 100 OR abs(b - a) >= 3",
    "common_hosts": r"WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)), '^www\.', '') AS host FROM pages) SELECT host, count(*) AS n FROM h WHERE host NOT IN ('', 'localhost') GROUP BY host ORDER BY n DESC, host LIMIT 200",
    "recent_sample": f"WITH {_ACTS}, p AS (SELECT id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_ms DESC, id DESC) AS INT) AS place FROM acts) SELECT id, place, place <= 5 AS detailed FROM p WHERE place <= 15",
    "audit_rows": f"WITH {_ACTS} SELECT id, title FROM acts WHERE app = 'click' AND contains(title, '7')",
    "day_apps": f"WITH {_ACTS}, s AS (SELECT user_id, start_ms // 86400000 AS day, list_sort(list(DISTINCT app)) AS apps FROM acts GROUP BY ALL), o AS (SELECT *, list_filter(apps, lambda x: x NOT IN ('click', 'view')) AS others FROM s) SELECT user_id, day, array_to_string(CASE WHEN len(others) > 0 THEN others ELSE apps END, '|') AS apps FROM o",
}
QUERIES = {name: globals()[name] for name in SQL}
