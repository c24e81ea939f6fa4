"""Matched segments, claims, thinned frames and replies over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import replies
from tidemark.operators import frames, matching, scores
from tidemark.plans.queries import _ACTS, _acts
from tidemark.sources.tables import table
from tidemark.streaming import jobs

#: Activities last so many times as long as in the table, so that they meet.
STRETCH, SLOT_MS = 500, 7_200_000


def _segments(spark: SparkSession, d: str, app: str) -> DataFrame:
    rows = _acts(spark, d).where(F.col("app") == app)
    return rows.select("user_id", "id", "start_ms", (F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * STRETCH).alias("end_ms"), "title")


def matched_segments(spark: SparkSession, d: str) -> DataFrame:
    found = matching.matched_segments(_segments(spark, d, "view"), _segments(spark, d, "click"), "user_id", SLOT_MS)
    return found.withColumn("ratio", F.round("ratio", 6))


def segment_report(spark: SparkSession, d: str) -> DataFrame:
    golden, produced = _segments(spark, d, "view"), _segments(spark, d, "click")
    return matching.segment_report(golden, produced, matching.matched_segments(golden, produced, "user_id", SLOT_MS), "user_id")


def claimed_blocks(spark: SparkSession, d: str) -> DataFrame:
    a = _acts(spark, d)
    steps = a.where("app = 'view'").select("user_id", F.col("id").alias("step"), F.col("start_ms").alias("at"), F.col("title").alias("app"))
    return matching.claimed_blocks(steps, a.where("app <> 'view'").select("user_id", "id", "start_ms", "end_ms", F.col("title").alias("app")), "user_id")


def thinned_frames(spark: SparkSession, d: str) -> DataFrame:
    look = F.lpad(F.bin((F.col("end_ms") - F.col("start_ms")) % 256), 8, "0")
    return frames.thinned(_acts(spark, d).select("user_id", F.col("start_ms").alias("at"), "id", look.alias("hash")), "user_id", 50.0).select("user_id", "id")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    a = _acts(spark, d)
    shown = a.where("app <> 'purchase'").select("user_id", F.col("start_ms").alias("at"), "id", F.lit(None).cast("string").alias("hash"))
    return frames.snapshots(shown, a.where("app = 'purchase'").select("user_id", F.col("start_ms").alias("t")), "user_id", 5).select("user_id", "id")


def leaked_tails(spark: SparkSession, d: str) -> DataFrame:
    """A user's day is an activity, whose frames are its events; what comes after is the day after."""
    length = F.col("end_ms") - F.col("start_ms")
    gray = F.array(length % 256, F.floor(length / 7) % 256, F.floor(length / 49) % 256).cast("array<int>")
    rows = _acts(spark, d).select("user_id", F.floor(F.col("start_ms") / 86_400_000).alias("day"), F.col("start_ms").alias("at"), "id", gray.alias("gray"))
    return frames.leaked_tails(rows, rows.withColumn("day", F.col("day") - 1), ["user_id", "day"]).select("user_id", "id")


def reply_values(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of events, as models write it: in a fence, alone, or amid words."""
    fence = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    said = F.when(F.col("event_id") % 3 == 0, fence).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("props"))).otherwise(F.concat(F.lit("I think "), F.col("props"), F.lit(" is right")))
    return table(spark, d, "events").select("event_id", F.get_json_object(replies.reply_json(said), "$.k").cast("bigint").alias("k"))


def task_scores(spark: SparkSession, d: str) -> DataFrame:
    """Parts that suppliers got back are golden sets, those of another kind of return are detections of the same suppliers; a seventh of the suppliers is a fixture."""
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("fixture"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("item"), "l_returnflag")
    verdict = F.element_at(F.array(*map(F.lit, ("keep", "reject", "unreviewed"))), (F.col("s") % 3 + 1).cast("int"))
    golden = lines.where("l_returnflag = 'R'").select("fixture", F.col("s").alias("g"), verdict.alias("verdict"), "item")
    return scores.task_scores(golden, lines.where("l_returnflag = 'A'").select("fixture", F.col("s").alias("d"), "item"), 0.08)


def mean_task_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.mean_scores(task_scores(spark, d), ["recall", "id_precision", "precision", "iou"])


def job_states(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as the life of a job: a signup queues it, views claim it, purchases complete it, errors fail it, clicks hand it back."""
    what = F.element_at(F.create_map(*(F.lit(x) for kv in (("signup", "enqueue"), ("view", "claim"), ("purchase", "complete"), ("error", "fail"), ("click", "release")) for x in kv)), F.col("app"))
    events = _acts(spark, d).select("user_id", F.col("start_ms").alias("at"), "id", what.alias("what"), F.concat(F.lit("error "), F.col("title")).alias("error"))
    return jobs.job_states(events, ["user_id"], 3, 40_000_000)


_JOBS = f"""{_ACTS}, e AS (SELECT user_id, start_ms AS t, app, 'error ' || title AS err, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, id) AS i FROM acts),
 st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS attempts, CAST(NULL AS BIGINT) AS enqueued_ms, CAST(NULL AS BIGINT) AS started_ms, CAST(NULL AS BIGINT) AS completed_ms, CAST(NULL AS BIGINT) AS next_ms, CAST(NULL AS VARCHAR) AS last_error FROM e UNION ALL
 SELECT e.user_id, e.i, CASE WHEN q THEN 'pending' WHEN c THEN 'running' WHEN f THEN 'completed' WHEN x THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END WHEN b THEN 'pending' ELSE status END,
 CASE WHEN c THEN attempts + 1 WHEN b THEN greatest(attempts - 1, 0) ELSE attempts END, CASE WHEN q THEN e.t ELSE enqueued_ms END, CASE WHEN c THEN e.t WHEN b THEN NULL ELSE started_ms END, CASE WHEN f THEN e.t ELSE completed_ms END,
 CASE WHEN x THEN CASE WHEN attempts < 3 THEN e.t + 40000000 END WHEN f OR b THEN NULL ELSE next_ms END, CASE WHEN x OR b THEN e.err WHEN f THEN NULL ELSE last_error END
 FROM st JOIN e ON e.user_id = st.user_id AND e.i = st.i + 1, LATERAL (SELECT e.app = 'signup' AND status IS NULL AS q, e.app = 'view' AND status IS NOT DISTINCT FROM 'pending' AND (next_ms IS NULL OR next_ms <= e.t) AS c,
 e.app = 'purchase' AND status IS NOT DISTINCT FROM 'running' AS f, e.app = 'error' AND status IS NOT DISTINCT FROM 'running' AS x, e.app = 'click' AND status IS NOT DISTINCT FROM 'running' AS b))"""
_SCORES = """go AS (SELECT DISTINCT l_suppkey % 7 AS fixture, l_suppkey AS g, CASE l_suppkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'unreviewed' END AS verdict, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'),
 de AS (SELECT DISTINCT l_suppkey % 7 AS fixture, l_suppkey AS d, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A'), gs AS (SELECT fixture, g, verdict, count(*) AS n_g FROM go GROUP BY ALL), ds AS (SELECT fixture, d, count(*) AS n_d FROM de GROUP BY ALL),
 sh AS (SELECT go.fixture, g, verdict, d, count(*) AS n FROM go JOIN de ON go.fixture = de.fixture AND go.item = de.item GROUP BY ALL), s2 AS (SELECT sh.*, n_g, n_d, n / n_g AS ratio FROM sh JOIN gs USING (fixture, g, verdict) JOIN ds USING (fixture, d)),
 be AS (SELECT * FROM (SELECT * FROM s2 WHERE verdict = 'keep' QUALIFY row_number() OVER (PARTITION BY fixture, g ORDER BY n DESC, d) = 1) WHERE ratio >= 0.08),
 ex AS (SELECT fixture, d, count(*) AS many FROM be GROUP BY ALL), mo AS (SELECT fixture, d, max(ratio) FILTER (verdict = 'reject') AS rj, max(ratio) FILTER (verdict = 'unreviewed') AS un, max(ratio) AS anyr, arg_min(g, (-ratio, g)) FILTER (verdict = 'reject') AS own FROM s2 GROUP BY ALL),
 re AS (SELECT ds.fixture, ds.d, own, CASE WHEN rj >= 0.08 THEN 'rejects' WHEN un >= 0.08 THEN 'unreviewed' WHEN anyr IS NULL THEN 'new' ELSE 'grazes' END AS kind FROM ds LEFT JOIN mo USING (fixture, d) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.fixture = ds.fixture AND ex.d = ds.d)),
 ci AS (SELECT de.fixture, EXISTS (SELECT 1 FROM go WHERE go.fixture = de.fixture AND go.item = de.item AND verdict = 'keep') AS k, EXISTS (SELECT 1 FROM go WHERE go.fixture = de.fixture AND go.item = de.item AND verdict = 'reject') AS r FROM de),
 fx AS (SELECT fixture FROM gs UNION SELECT fixture FROM ds), o AS (SELECT fixture, (SELECT count(*) FROM gs WHERE gs.fixture = fx.fixture AND verdict = 'keep') AS positives, (SELECT count(*) FROM be WHERE be.fixture = fx.fixture) AS found, (SELECT count(*) FROM gs WHERE gs.fixture = fx.fixture AND verdict = 'reject') AS negatives,
 (SELECT count(DISTINCT own) FROM re WHERE re.fixture = fx.fixture AND kind = 'rejects') AS rejected_again, (SELECT count(*) FROM ds WHERE ds.fixture = fx.fixture) AS detections, (SELECT count(*) FROM ex WHERE ex.fixture = fx.fixture) AS explained, (SELECT count(*) FROM ex WHERE ex.fixture = fx.fixture AND many > 1) AS bundled,
 (SELECT count(*) FROM re WHERE re.fixture = fx.fixture AND kind = 'rejects') AS rejects, (SELECT count(*) FROM re WHERE re.fixture = fx.fixture AND kind = 'unreviewed') AS unreviewed, (SELECT count(*) FROM re WHERE re.fixture = fx.fixture AND kind = 'grazes') AS grazes, (SELECT count(*) FROM re WHERE re.fixture = fx.fixture AND kind = 'new') AS "new",
 (SELECT count(*) FROM ci WHERE ci.fixture = fx.fixture) AS cited, (SELECT count(*) FROM ci WHERE ci.fixture = fx.fixture AND k) AS cited_keep, (SELECT count(*) FROM ci WHERE ci.fixture = fx.fixture AND r AND NOT k) AS cited_reject,
 (SELECT round(avg(ratio), 6) FROM be WHERE be.fixture = fx.fixture) AS recall_of_found, (SELECT round(avg(n / n_d), 6) FROM be WHERE be.fixture = fx.fixture) AS precision, (SELECT round(avg(n / (n_g + n_d - n)), 6) FROM be WHERE be.fixture = fx.fixture) AS iou FROM fx),
 sc AS (SELECT *, CASE WHEN positives > 0 THEN round(found / positives, 6) ELSE 0.0 END AS recall, CASE WHEN cited > 0 THEN round(cited_keep / cited, 6) END AS id_precision FROM o)"""
_PAIRS = f"""{_ACTS}, s AS (SELECT user_id, id, app, title, start_ms, start_ms + (end_ms - start_ms) * {STRETCH} AS end_ms FROM acts),
 pairs AS (SELECT g.user_id, g.id AS a, p.id AS b, least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) AS overlap_ms,
 (least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms)) / greatest(1, least(g.end_ms - g.start_ms, p.end_ms - p.start_ms)) AS ratio, CASE WHEN g.title <> '' AND g.title = p.title THEN 1 ELSE 0 END AS same
 FROM s g JOIN s p ON g.user_id = p.user_id AND g.app = 'view' AND p.app = 'click' AND g.start_ms < p.end_ms AND p.start_ms < g.end_ms),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ratio DESC, same DESC, a, b) AS i FROM pairs WHERE ratio >= 0.3 AND overlap_ms > 0),
 st AS (SELECT user_id, i, a, b, overlap_ms, ratio, true AS taken, [a] AS ga, [b] AS gb FROM o WHERE i = 1 UNION ALL
 SELECT o.user_id, o.i, o.a, o.b, o.overlap_ms, o.ratio, t, CASE WHEN t THEN list_append(st.ga, o.a) ELSE st.ga END, CASE WHEN t THEN list_append(st.gb, o.b) ELSE st.gb END
 FROM st JOIN o ON o.user_id = st.user_id AND o.i = st.i + 1, LATERAL (SELECT NOT list_contains(st.ga, o.a) AND NOT list_contains(st.gb, o.b) AS t)),
 found AS (SELECT user_id, a, b, overlap_ms, round(ratio, 6) AS ratio FROM st WHERE taken)"""
SQL = {
    "matched_segments": f"WITH RECURSIVE {_PAIRS} SELECT * FROM found",
    "segment_report": f"WITH RECURSIVE {_PAIRS}, c AS (SELECT user_id, count(*) FILTER (app = 'view') AS golden, count(*) FILTER (app = 'click') AS produced FROM s WHERE app IN ('view', 'click') GROUP BY user_id), m AS (SELECT user_id, count(*) AS m FROM found GROUP BY user_id), r AS (SELECT user_id, golden, produced, coalesce(m, 0) AS matched FROM c LEFT JOIN m USING (user_id)) SELECT *, CASE WHEN golden > 0 THEN round(matched / golden, 6) END AS coverage, golden - matched AS missed, produced - matched AS extra FROM r",
    "claimed_blocks": f"WITH {_ACTS}, st AS (SELECT user_id, id AS step, start_ms AS t0, title, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, id) AS t1 FROM acts WHERE app = 'view'), c AS (SELECT st.user_id, st.step, a.id, a.end_ms - a.start_ms AS len, a.start_ms FROM st JOIN acts a ON a.user_id = st.user_id AND a.app <> 'view' AND a.title = st.title AND a.start_ms >= t0 AND (t1 IS NULL OR a.start_ms < t1)), b AS (SELECT user_id, step, count(*) AS n, arg_min(id, (-len, start_ms, id)) AS target FROM c GROUP BY ALL) SELECT st.user_id, st.step, coalesce(n, 0) AS claimed, target FROM st LEFT JOIN b USING (user_id, step)",
    "thinned_frames": f"""WITH RECURSIVE {_ACTS}, f AS (SELECT user_id, id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lpad(bin((end_ms - start_ms) % 256), 8, '0') AS h FROM acts WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, id)),
 st AS (SELECT user_id, i, id, h AS kept, true AS k, 1 AS many, i AS at_i FROM f WHERE i = 1 UNION ALL
 SELECT f.user_id, f.i, f.id, CASE WHEN far THEN f.h ELSE st.kept END, far, CASE WHEN far THEN st.many + 1 ELSE st.many END, CASE WHEN far THEN f.i ELSE st.at_i END FROM st JOIN f ON f.user_id = st.user_id AND f.i = st.i + 1 AND f.i < f.n, LATERAL (SELECT hamming(st.kept, f.h) * 100.0 / 8 >= 50 AS far)),
 tail AS (SELECT st.user_id, st.at_i, st.many, hamming(st.kept, f.h) * 100.0 / 8 AS d FROM st JOIN f ON f.user_id = st.user_id AND f.i = f.n AND st.i = f.n - 1)
 SELECT f.user_id, f.id FROM f LEFT JOIN st ON st.user_id = f.user_id AND st.i = f.i LEFT JOIN tail ON tail.user_id = f.user_id WHERE f.i = f.n OR (st.k AND NOT coalesce(tail.d < 50 AND tail.many > 1 AND tail.at_i = f.i, false))""",
    "task_scores": f"WITH {_SCORES} SELECT * FROM sc",
    "mean_task_scores": f"WITH {_SCORES} SELECT count(*) AS rows, round(avg(recall), 6) AS recall, round(avg(id_precision), 6) AS id_precision, round(avg(precision), 6) AS precision, round(avg(iou), 6) AS iou FROM sc",
    "job_states": f"WITH RECURSIVE {_JOBS} SELECT user_id, status, attempts, enqueued_ms, started_ms, completed_ms, next_ms, last_error FROM st WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1",
    "leaked_tails": f"""WITH {_ACTS}, g AS (SELECT user_id, start_ms // 86400000 AS day, start_ms AS t, id, [(end_ms - start_ms) % 256, (end_ms - start_ms) // 7 % 256, (end_ms - start_ms) // 49 % 256] AS gray FROM acts),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY t DESC, id DESC) AS r, row_number() OVER (PARTITION BY user_id, day ORDER BY t, id) AS f, count(*) OVER (PARTITION BY user_id, day) AS n FROM g), c AS (SELECT *, least(3, n - 1) AS many FROM r),
 p AS (SELECT a.user_id, a.day, a.id, a.r, min((abs(a.gray[1] - b.gray[1]) + abs(a.gray[2] - b.gray[2]) + abs(a.gray[3] - b.gray[3])) / 3 / 255 * 100) FILTER (b.day = a.day) AS own, min((abs(a.gray[1] - b.gray[1]) + abs(a.gray[2] - b.gray[2]) + abs(a.gray[3] - b.gray[3])) / 3 / 255 * 100) FILTER (b.day = a.day + 1) AS nxt
 FROM c a JOIN c b ON a.user_id = b.user_id AND a.r <= a.many AND ((b.day = a.day AND b.r > a.many AND b.r <= a.many + 2) OR (b.day = a.day + 1 AND b.f <= 2)) GROUP BY ALL)
 SELECT user_id, id FROM (SELECT *, min(CASE WHEN coalesce(nxt - own < -0.5, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY r ROWS UNBOUNDED PRECEDING) AS gone FROM p) WHERE gone = 1""",
    "snapshots": f"""WITH {_ACTS}, one AS (SELECT user_id, start_ms AS t, min(id) AS id FROM acts WHERE app <> 'purchase' GROUP BY ALL), a AS (SELECT DISTINCT user_id, start_ms AS q FROM acts WHERE app = 'purchase'), n AS (SELECT a.user_id, arg_min(t, (abs(t - q), t)) AS t FROM a JOIN one USING (user_id) GROUP BY a.user_id, q),
 e AS (SELECT user_id, unnest([min(t), max(t)]) AS t FROM one GROUP BY user_id), c AS (SELECT user_id, t FROM n UNION SELECT user_id, t FROM e), r AS (SELECT c.user_id, id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.t) - 1 AS i, count(*) OVER (PARTITION BY c.user_id) AS n FROM c JOIN one USING (user_id, t))
 SELECT user_id, id FROM r WHERE n <= 5 OR i = 0 OR i = n - 1 OR i IN (SELECT floor(j * (n - 3) / 2.0 + 0.5) + 1 FROM range(3) AS g(j))""",
    "reply_values": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
QUERIES = {name: globals()[name] for name in SQL}
