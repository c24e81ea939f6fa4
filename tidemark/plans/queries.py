"""The engine's queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.operators import intervals, patterns, search, timeline
from tidemark.sources.tables import activities, table

JAN_10 = 1_704_844_800_000
NOW = 1_706_572_800_000  # 30 January 2024
_ACTS = """acts AS (SELECT event_id AS id, user_id, event_type AS app, coalesce(json_extract_string(props, '$.k'), '') AS title, epoch_us(ts) // 1000 AS start_ms,
 epoch_us(ts) // 1000 + CAST(round(greatest(coalesce(value, 0.0), 0.0) * 1000) AS BIGINT) AS end_ms FROM events)"""
_ISLANDS = """marked AS (SELECT *, max(end_ms) OVER w AS seen FROM acts WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 numbered AS (SELECT *, sum(CASE WHEN start_ms <= seen + {bridge} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM marked),
 islands AS (SELECT user_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY ALL)"""
_ACTIVE = "SELECT user_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS active_ms, round(sum(end_ms - start_ms) / 60000, 1) AS active_min FROM islands GROUP BY user_id"
_TERMS = r"[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> '']"
QUERY_TERMS = ["the", "stand", "idiot"]
_BM25 = f"""t AS (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents)), size AS (SELECT count(*) AS docs, avg(len({_TERMS})) AS mean FROM documents),
 hits AS (SELECT term, doc_id, n, count(*) AS tf FROM t WHERE term IN ('the', 'stand', 'idiot') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
 bm AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM hits JOIN df USING (term), size GROUP BY doc_id),
 best AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50)"""
_VEC = """near AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(sqrt(list_sum([(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) ** 2 FOR i IN range(1, len(q.embedding) + 1)])), 6) AS distance
 FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
 nearest AS (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM near {where} QUALIFY rank <= 20)"""
_TEXTS = f"""w AS (SELECT DISTINCT doc_id AS query_id, unnest({_TERMS}) AS term FROM documents WHERE doc_id % 50 = 0), wanted AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= 3),
 t AS (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents)), size AS (SELECT count(*) AS docs, avg(len({_TERMS})) AS mean FROM documents),
 hits AS (SELECT term, doc_id, n, count(*) AS tf FROM t WHERE term IN (SELECT term FROM wanted) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
 scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM wanted JOIN hits USING (term) JOIN df USING (term), size GROUP BY ALL),
 best AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored QUALIFY rank <= 20),
 r AS (SELECT query_id, vec_id AS id, 0 AS part, rank FROM nearest UNION ALL SELECT query_id, doc_id, 1, rank FROM best)"""


def _acts(spark: SparkSession, d: str) -> DataFrame:
    return activities(table(spark, d, "events"))


def browse_timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sample_uniform(timeline.overlapping(_acts(spark, d), JAN_10, JAN_10 + 5 * timeline.DAY_MS), 5).select("id", "user_id", "app", "start_ms", "end_ms")


def timeline_overlap(spark: SparkSession, d: str) -> DataFrame:
    return timeline.overlapping(_acts(spark, d), JAN_10, JAN_10 + timeline.DAY_MS, "CLI")


def recent_page(spark: SparkSession, d: str) -> DataFrame:
    return timeline.recent(_acts(spark, d), 50, 10).select("id", "start_ms")


def rollup_runs(spark: SparkSession, d: str) -> DataFrame:
    return timeline.rollup_runs(_acts(spark, d)).select("user_id", "day", "app", "title", "start_ms", "end_ms", "n")


def day_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.day_summary(timeline.rollup_runs(_acts(spark, d)))


def carried_value(spark: SparkSession, d: str) -> DataFrame:
    rows = _acts(spark, d).withColumn("bought", F.when(F.col("app") == "purchase", F.col("title")))
    return timeline.carried(rows, "bought").select("id", "carried")


def active_time(spark: SparkSession, d: str) -> DataFrame:
    return intervals.active_time(_acts(spark, d), ["user_id"])


def active_time_bridged(spark: SparkSession, d: str) -> DataFrame:
    return intervals.active_time(_acts(spark, d), ["user_id"], 300_000)


def largest_gap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.largest_gap(_acts(spark, d))


def densest_run(spark: SparkSession, d: str) -> DataFrame:
    return intervals.densest_run(_acts(spark, d), 5)


def frame_durations(spark: SparkSession, d: str) -> DataFrame:
    return intervals.durations_by_lead(_acts(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _acts(spark, d).withColumnRenamed("start_ms", "t")
    return a.where("app = 'purchase'").select("user_id", "t"), a.where("app = 'click'").select("user_id", "t")


def nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    return intervals.as_of(*_sides(spark, d), "user_id")


def as_of_backward(spark: SparkSession, d: str) -> DataFrame:
    return intervals.as_of(*_sides(spark, d), "user_id", "backward")


def frames_in_windows(spark: SparkSession, d: str) -> DataFrame:
    a = _acts(spark, d)
    points = a.where("app = 'click'").select("user_id", F.col("start_ms").alias("t"), "id")
    windows = a.where("app = 'view'").select("user_id", "start_ms", "end_ms", F.col("id").alias("window"))
    return intervals.contained(points, windows, "user_id", 600_000).select("id", "window", "t")


def app_totals(spark: SparkSession, d: str) -> DataFrame:
    return patterns.app_totals(_acts(spark, d))


def pattern_stats(spark: SparkSession, d: str) -> DataFrame:
    return patterns.pattern_stats(_acts(spark, d), 14, NOW)


def modal_title(spark: SparkSession, d: str) -> DataFrame:
    return patterns.modal_title(_acts(spark, d), ["app"])


def recurrence(spark: SparkSession, d: str) -> DataFrame:
    return patterns.recurrence(_acts(spark, d), ["user_id"])


def close_repeats(spark: SparkSession, d: str) -> DataFrame:
    return patterns.close_repeats(_acts(spark, d), 3_600_000)


def coherence(spark: SparkSession, d: str) -> DataFrame:
    return patterns.coherence(table(spark, d, "embeddings"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def knn(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest_of_each(table(spark, d, "embeddings"), _queries(spark, d), 20)


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest_of_each(table(spark, d, "embeddings").where("label % 2 = 1"), _queries(spark, d), 20)


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), QUERY_TERMS, 50)


def _text_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, term): the three longest words of every document whose id is divisible by 50, of equal ones the first by code points."""
    words = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(search.terms(F.col("text")))).alias("term"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "term"))
    return words.withColumn("place", place).where("place <= 3").drop("place")


def bm25_each(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_of_each(table(spark, d, "documents"), _text_queries(spark, d), 20)


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return knn(spark, d).withColumnRenamed("vec_id", "id"), bm25_each(spark, d).withColumnRenamed("doc_id", "id")


def fused_search(spark: SparkSession, d: str) -> DataFrame:
    return search.fused_of_each([*_rankings(spark, d)], 30)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid_of_each(*_rankings(spark, d), 30)


def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select(web.host(F.col("url")).alias("host")).where("host is not null")
    h = h.select("host", web.domain(F.col("host")).alias("domain"), web.is_private(F.col("host")).alias("private"))
    return h.groupBy("host", "domain", "private").agg(F.count(F.lit(1)).alias("n"))


def label_auc(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.round(F.length("text") / 100)).alias("score"))
    return patterns.auc(table(spark, d, "labels").join(docs, "doc_id").select("score", (F.col("quality") == 1).alias("positive")))


_RUNS = """ordered AS (SELECT *, start_ms // 86400000 AS day FROM acts), lagged AS (SELECT *, lag(app) OVER w AS pa, lag(title) OVER w AS pt, lag(end_ms) OVER w AS pe FROM ordered WINDOW w AS (PARTITION BY user_id, day ORDER BY start_ms, id)),
 runs AS (SELECT *, sum(CASE WHEN pa = app AND pt = title AND start_ms - pe <= 90000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, day ORDER BY start_ms, id ROWS UNBOUNDED PRECEDING) AS run FROM lagged),
 rolled AS (SELECT user_id, day, run, any_value(app) AS app, any_value(title) AS title, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM runs GROUP BY user_id, day, run)"""
_SIDES = "l AS (SELECT user_id, start_ms AS t FROM acts WHERE app = 'purchase'), r AS (SELECT user_id, start_ms AS t FROM acts WHERE app = 'click'), m AS (SELECT l.user_id, l.t, (SELECT max(r.t) FROM r WHERE r.user_id = l.user_id AND r.t <= l.t) AS b, (SELECT min(r.t) FROM r WHERE r.user_id = l.user_id AND r.t >= l.t) AS a FROM l)"
_WEEK = "CASE WHEN unit = 1 THEN {d} ELSE CAST(floor(({d} + 3) / 7) AS BIGINT) * 7 - 3 END"

SQL = {
    "browse_timeline": f"WITH {_ACTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM acts WHERE end_ms >= {JAN_10} AND start_ms <= {JAN_10 + 5 * 86400000}) SELECT id, user_id, app, start_ms, end_ms FROM s WHERE n <= 5 OR i IN (SELECT floor(k * (n - 1) / 4 + 0.5) FROM range(5) AS g(k))",
    "timeline_overlap": f"WITH {_ACTS} SELECT * FROM acts WHERE end_ms >= {JAN_10} AND start_ms <= {JAN_10 + 86400000} AND (contains(lower(app), 'cli') OR contains(lower(title), 'cli'))",
    "recent_page": f"WITH {_ACTS} SELECT id, start_ms FROM acts ORDER BY start_ms DESC, id DESC LIMIT 50 OFFSET 10",
    "rollup_runs": f"WITH {_ACTS}, {_RUNS} SELECT user_id, day, app, title, start_ms, end_ms, n FROM rolled",
    "day_summary": f"WITH {_ACTS}, {_RUNS} SELECT user_id, day, count(*) AS runs, CAST(sum(n) AS BIGINT) AS captures, CAST(sum(end_ms - start_ms) AS BIGINT) AS run_ms FROM rolled GROUP BY user_id, day",
    "carried_value": f"WITH {_ACTS} SELECT id, last_value(CASE WHEN app = 'purchase' THEN title END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM acts",
    "active_time": f"WITH {_ACTS}, {_ISLANDS.format(bridge=0)} {_ACTIVE}",
    "active_time_bridged": f"WITH {_ACTS}, {_ISLANDS.format(bridge=300000)} {_ACTIVE}",
    "largest_gap": f"WITH {_ACTS}, g AS (SELECT user_id, start_ms, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, id) - start_ms AS gap_ms FROM acts) SELECT user_id, gap_ms, start_ms AS after_ms FROM g WHERE gap_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap_ms DESC, start_ms) = 1",
    "densest_run": f"WITH {_ACTS}, g AS (SELECT user_id, start_ms, lead(start_ms, 4) OVER (PARTITION BY user_id ORDER BY start_ms, id) - start_ms AS span_ms FROM acts) SELECT user_id, span_ms, start_ms AS from_ms FROM g WHERE span_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY span_ms, start_ms) = 1",
    "frame_durations": f"WITH {_ACTS}, g AS (SELECT user_id, id, start_ms, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, id) - start_ms AS d FROM acts), h AS (SELECT user_id, id, start_ms, CASE WHEN d <= 0 THEN 1000 ELSE d END AS d FROM g) SELECT user_id, id, coalesce(d, lag(d) OVER (PARTITION BY user_id ORDER BY start_ms, id), 1000) AS duration_ms FROM h",
    "nearest_frame": f"WITH {_ACTS}, {_SIDES} SELECT user_id, t, CASE WHEN t - b <= a - t THEN b ELSE coalesce(a, b) END AS match FROM m",
    "as_of_backward": f"WITH {_ACTS}, {_SIDES} SELECT user_id, t, b AS match FROM m",
    "frames_in_windows": f"WITH {_ACTS} SELECT p.id, w.id AS \"window\", p.start_ms AS t FROM acts p JOIN acts w ON p.user_id = w.user_id AND p.start_ms BETWEEN w.start_ms AND w.end_ms WHERE p.app = 'click' AND w.app = 'view'",
    "app_totals": f"WITH {_ACTS} SELECT app, count(*) AS n, max(end_ms) AS last_ms, count(DISTINCT start_ms // 86400000) AS days FROM acts GROUP BY app ORDER BY n DESC, last_ms DESC, app LIMIT 100",
    "pattern_stats": f"WITH {_ACTS}, s AS (SELECT user_id, app, count(*) AS seen, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, max(start_ms) AS last_ms FROM acts WHERE start_ms BETWEEN {NOW - 14 * 86400000} AND {NOW} GROUP BY user_id, app) SELECT *, total_ms // seen AS mean_ms, round(seen * 7.0 / 14, 4) AS per_week, seen < 2 AND total_ms < 1800000 AS noise FROM s",
    "modal_title": f"WITH {_ACTS}, t AS (SELECT app, trim(title) AS title, count(*) AS n, min((start_ms, id)) AS f FROM acts WHERE trim(title) <> '' GROUP BY ALL) SELECT app, title, n FROM t QUALIFY row_number() OVER (PARTITION BY app ORDER BY n DESC, f) = 1",
    "recurrence": f"WITH {_ACTS}, d AS (SELECT user_id, start_ms // 86400000 AS d FROM acts), s AS (SELECT user_id, min(d) AS lo, max(d) AS hi, CASE WHEN max(d) - min(d) < 24 THEN 1 ELSE 7 END AS unit FROM d GROUP BY user_id), e AS (SELECT *, {_WEEK.format(d='lo')} AS blo, {_WEEK.format(d='hi')} AS bhi FROM s), p AS (SELECT user_id, unit, unnest(range(greatest(blo, bhi - 23 * unit), bhi + 1, unit)) AS bucket FROM e), c AS (SELECT user_id, {_WEEK.format(d='d')} AS bucket, count(*) AS n FROM d JOIN s USING (user_id) GROUP BY ALL) SELECT user_id, unit, bucket, coalesce(n, 0) AS n FROM p LEFT JOIN c USING (user_id, bucket)",
    "close_repeats": f"WITH {_ACTS} SELECT id, count(*) OVER (PARTITION BY user_id, app, title ORDER BY start_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, app, title, start_ms) AS earlier FROM acts",
    "coherence": "WITH x AS (SELECT label, vec_id, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m ** 2)) AS norm FROM m GROUP BY label HAVING norm > 0), c AS (SELECT x.label, vec_id, sum(x * m / norm) / sqrt(sum(x ** 2)) AS c FROM x JOIN m ON x.label = m.label AND x.dim = m.dim JOIN n ON n.label = x.label GROUP BY ALL) SELECT label, round(avg(c), 5) AS coherence, count(*) AS members FROM c GROUP BY label",
    "knn": f"WITH {_VEC.format(where='')} SELECT * FROM nearest",
    "knn_filtered": f"WITH {_VEC.format(where='WHERE label % 2 = 1')} SELECT * FROM nearest",
    "bm25_each": f"WITH {_VEC.format(where='')}, {_TEXTS} SELECT * FROM best",
    "bm25": f"WITH {_BM25} SELECT * FROM best",
    "fused_search": f"WITH {_VEC.format(where='')}, {_TEXTS}, f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM r GROUP BY ALL) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 30",
    "hybrid_search": f"WITH {_VEC.format(where='')}, {_TEXTS}, f AS (SELECT query_id, id, min((part, rank)) AS a FROM r GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY a) AS INT) AS rank FROM f QUALIFY rank <= 30",
    "page_hosts": r"WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1)), '^www\.', '') AS host FROM pages), b AS (SELECT host, regexp_replace(host, ':[0-9]+$', '') AS bare FROM h WHERE host <> '') SELECT host, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare ELSE regexp_extract(bare, '([^.]+\.)?[^.]+$', 0) END AS domain, regexp_matches(bare, '^(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[::1\])$') AS private, count(*) AS n FROM b GROUP BY ALL",
    "label_auc": "WITH d AS (SELECT round(length(text) / 100) AS score, quality = 1 AS pos FROM labels JOIN documents USING (doc_id)), s AS (SELECT score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM d GROUP BY score), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM b",
}
QUERIES = {name: globals()[name] for name in SQL}
