"""Nulls, ties and empty inputs of the profile, ledger, exclusion and label operators."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import exclusions, ledger, membership, profile, timeline

ACTS = "id int, user_id int, app string, title string, start_ms bigint, end_ms bigint"


def acts(spark, n):
    return spark.createDataFrame([(i, 1, "a", None, i * 1000, i * 1000 + 500) for i in range(n)], ACTS)


@pytest.mark.parametrize(("n", "most", "want"), [(0, 6, []), (3, 6, [0, 1, 2]), (10, 6, [0, 1, 3, 6, 8, 9]), (10, 2, [0, 9]), (10, 1, [0]), (10, 0, []), (10, 3, [0, 1, 9])])
def test_spaced(spark, n, most, want):
    assert sorted(r.id for r in profile.spaced(acts(spark, n), most).collect()) == want


def test_exclusions(spark):
    urls = ["https://www.a.com/x", "http://m.A.com:80/", "http://evil-a.com/", "http://b.org/q?x=1&utm_y", None, "no address"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = rows.select("i", exclusions.excluded_by(F.col("url"), ["a.com", "?x=*utm"]).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == ["a.com", "a.com", None, "?x=*utm", None, None]


def test_ledger(spark):
    day = timeline.DAY_MS
    rows = spark.createDataFrame([(1, 1, "a", "t", 5 * day + 1, 5 * day + 2), (2, 1, "a", "u", 5 * day + 1, 5 * day + 9)], ACTS)
    done = spark.createDataFrame([(6,), (None,)], "day bigint")
    assert sorted(r.day for r in ledger.missing_days(rows, done, 8 * day).collect()) == [5, 7]
    assert ledger.missing_days(rows.limit(0), done, 8 * day).collect() == []
    assert [r.id for r in ledger.latest(rows, ["user_id"], ["start_ms", "id"]).collect()] == [2]
    assert ledger.delta(rows, None).count() == 2
    assert [r.id for r in ledger.delta(rows, 5 * day + 10, 1).collect()] == [2]


def test_attached(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, [math.nan, 1.0]), (5, [1.0]), (6, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.centroid, r.sim) for r in profile.attached(rows, {9: [1.0, 0.0], 7: [1.0, 0.0], 8: [0.0, 1.0]}).collect()}
    assert got == {1: (7, 1.0), 2: (None, 0.1), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, 0.0)}
    assert {r.centroid for r in profile.attached(rows, {}).collect()} == {None}


def test_attached_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)] + [(99, None)], "vec_id bigint, embedding array<double>")
    centroids = {100 + i: [math.cos(i / 3), math.sin(i / 3)] for i in range(17)} | {90: [math.cos(4 / 3), math.sin(4 / 3)]}
    whole = sorted((r.vec_id, r.centroid, r.sim) for r in profile.attached(rows, centroids, 0.9).collect() if r.vec_id != 99)
    monkeypatch.setattr(profile, "CENTROID_BLOCK", 4)
    got = {r.vec_id: r for r in profile.attached(rows, centroids, 0.9).collect()}
    assert sorted((r.vec_id, r.centroid, r.sim) for r in got.values() if r.vec_id != 99) == whole
    assert got[99].centroid is None and got[99].sim is None


def test_costs_and_titles(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 0), ("x", 5, 5), (None, 5, 5)], "model string, i bigint, o bigint")
    price = profile.cost(F.col("model"), F.col("i"), F.col("o"), {"m": (0.5, 1.0)})
    assert calls.agg(F.sum(price)).first()[0] == 0.5
    assert calls.where("model is null").agg(F.sum(price)).first()[0] is None
    names = spark.createDataFrame([(x,) for x in ["b", "b", "B", "B", "B", " ", None, "c", "a", "a"]], "label string")
    assert [tuple(r) for r in profile.known_titles(names).collect()] == [("B", 3), ("a", 2)]
    assert tuple(profile.span_stats(acts(spark, 0)).first()) == (0, None, None, None)


def test_labels(spark):
    row = spark.sql("SELECT CAST(3723000 AS BIGINT) AS long, CAST(999 AS BIGINT) AS short, array(' a\n', '', NULL, 'bcd') AS steps, CAST(NULL AS STRING) AS none, ' ' AS blank")
    c = F.col
    got = row.select(
        labels.duration_text(c("long")), labels.duration_text(c("short")), labels.step_list(c("steps"), 2, 2), labels.step_list(F.lit(None).cast("array<string>")),
        labels.signature_text(c("none"), c("blank"), F.lit("x")), labels.viewed_label(c("blank"), c("none"), F.lit("app")),
    ).first()
    assert tuple(got) == ("1h 2m 3s", "0s", ["a", "bc"], [], "x", "Viewed app")


def test_arms(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2, None], [2, 3, 3]))
    assert sorted((r.k or 0, r.side) for r in membership.differing(a, b, ["k"]).collect()) == [(0, "a"), (1, "a"), (3, "b")]
    members = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2), ("y", 5)], "g string, k int")
    rows = spark.createDataFrame([(1, 10), (2, None)], "k int, v int")
    assert [tuple(r) for r in membership.resolved_totals(members, rows, "g", "k", "v").collect()] == [("x", 10)]
    both = spark.createDataFrame([(1, -5.0, False), (2, None, True), (3, 0.05, None), (4, None, None)], "k int, change double, f boolean")
    assert [r.k for r in membership.review_first(both, F.col("f"), 0.1).collect()] == [1, 2]


def test_hosts_and_apps(spark):
    hosts = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,), ("x",)], "host string")
    assert [tuple(r) for r in profile.host_counts(hosts, ["x"]).collect()] == [("b", 2), ("a", 1)]
    assert profile.host_counts(hosts, []).count() == 3
    apps = spark.createDataFrame([(["br", "", "ed", "ed", None],), (["br"],), ([],)], "apps array<string>")
    assert [r[0] for r in apps.coalesce(1).select(labels.run_apps(F.col("apps"), ["br"])).collect()] == [["ed"], ["br"], []]
