"""Nulls, ties and empty inputs of the member, trend and text operators."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text, web
from tidemark.operators import membership, trends


def test_sets(spark):
    golden = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 9)], "g string, item int")
    detected = spark.createDataFrame([("y", 1), ("x", 2), ("x", None)], "d string, item int")
    assert [tuple(r) for r in membership.best_overlap(golden, detected).collect()] == [("a", "x", 1, 0.5, 0.5, 0.333333)]
    assert membership.best_overlap(golden.limit(0), detected).collect() == []


def test_missing_keys(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert {r.k for r in membership.without(rows, rows.where("k = 1"), "k").collect()} == {None, 2}
    assert [r.k for r in membership.pruned(rows, rows.where("k = 1"), "k").collect()] == [1]


def test_runs_and_gates(spark):
    acts = spark.createDataFrame([(1, 1, None, 0), (2, 1, None, 1), (3, 1, "a", 2), (4, 1, "a", 3), (5, 2, "a", 0)], "id int, user_id int, app string, start_ms bigint")
    assert sorted((r.user_id, r.run, r.app, r.n) for r in trends.run_lengths(acts.na.fill("-"), "app").collect()) == [(1, 1, "-", 2), (1, 2, "a", 2), (2, 1, "a", 1)]
    assert sorted(r.id for r in trends.changes_only(acts, ["app"]).collect()) == [1, 3, 5]
    assert sorted(r.id for r in trends.gated(acts, F.col("app").isNotNull(), F.col("id") == 3).collect()) == [1, 2, 4, 5]


def test_scores_of_misses(spark):
    ranks = spark.createDataFrame([(1,), (None,), (11,), (2,)], "rank int")
    assert tuple(trends.retrieval_scores(ranks).first()) == (0.375, 0.25, 0.5, 4)


def test_texts(spark):
    row = spark.sql("SELECT '4111111111111111' AS good, '4111111111111112' AS bad, '' AS none, CAST(NULL AS STRING) AS missing, '★  a ‍ b' AS title")
    c = [text.passes_luhn(F.col(x)) for x in ("good", "bad", "none", "missing")]
    got = row.select(*c, text.plain_title(F.col("title")), text.mentions("A", F.col("missing"), F.col("title")), text.pair_key(F.lit(3), F.lit(2))).first()
    assert tuple(got) == (True, False, False, None, "a b", True, "2|3")


def test_private_hosts(spark):
    hosts = ["localhost:80", "127.0.0.1", "10.1.2.3", "10.evil.com", "10.1.2.256", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1:8080", "192.169.1.1", "[::1]", "example.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").coalesce(1)
    got = [r.h for r in rows.where(web.is_private(F.col("h"))).collect()]
    assert got == ["localhost:80", "127.0.0.1", "10.1.2.3", "169.254.1.1", "172.16.0.1", "192.168.1.1:8080", "[::1]"]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Sets go to as many tasks as bound the pairs of one, and pairs of sets aren't shuffled; counts and ties as by plain sets."""
    r = random.Random(4)
    golden, detected = ([(k, r.randrange(60)) for k in range(25) for _ in range(r.randrange(1, 12))] for _ in range(2))
    monkeypatch.setattr(membership, "ROWS_OF_TASK", 5)
    found = membership.best_overlap(spark.createDataFrame(golden, "g long, item long"), spark.createDataFrame(detected, "d long, item long"))
    sets = [{k: {i for o, i in rows if o == k} for k, _ in rows} for rows in (golden, detected)]
    best = {g: min((-len(x & y), d) for d, y in sets[1].items()) for g, x in sets[0].items()}
    assert {r.g: (-r.shared, r.d) for r in found.collect()} == {g: x for g, x in best.items() if x[0]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-len(golden) // 5)}), REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(g#\d+L, d#", plan)
