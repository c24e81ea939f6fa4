"""The pattern view, threshold sweeps and search over clusters: odd rows and ties."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import patterns, views

DAY = 86_400_000


def test_view(spark):
    now = 100 * DAY
    clusters = spark.createDataFrame([(1, " Named ", ["a", "b"]), (2, "", []), (3, None, None), (4, "", []), (5, "gone", [])], "c long, label string, steps array<string>")
    rows = [
        (1, 10, "x", [], "A", now, 60_000), (2, 20, " t ", ["one"], "A", now - 5, 1), (2, 21, "t", ["two"], "B", now - 4, 2_000_000), (2, 22, "u", ["three"], "B", now - 1, 1), (2, 23, "", ["four"], "A", now, 0),
        (3, 30, None, None, None, now, 2_000_000), (4, 40, "u", [], "A", now - 2, 5), (4, 41, "v", ["five"], "A", now - 1, 5), (5, 50, "old", ["x"], "A", now - 28 * DAY, 5), (5, 51, "new", ["x"], "A", now + 1, 5),
    ]
    members = spark.createDataFrame(rows, "c long, id long, title string, steps array<string>, app string, start_ms long, active_ms long")
    view = views.clusters_view(clusters, members, ["c"], now)
    got = {r.c: (r.title, r.steps, r.seen, r.mean_ms, r.apps, r.noise) for r in view.collect()}
    assert got == {
        1: ("Named", ["a", "b"], 1, 60_000, ["A"], True), 2: ("t", ["two"], 4, 500_000, ["A", "B"], False), 3: ("Untitled task", [], 1, 2_000_000, [], False), 4: ("u", ["five"], 2, 5, ["A"], False),
    }
    listed = views.listed(view.withColumn("k", F.lit(0)), ["k"])
    assert [(r.c, r["rank"], r.hidden) for r in listed.orderBy("rank").collect()] == [(2, 1, 1), (4, 2, 1), (3, 3, 1)]
    assert {r.c for r in views.searched(view, " FIVE ").collect()} == {4} and views.searched(view, " ").count() == 0 and views.searched(view, "named").count() == 0
    assert views.clusters_view(clusters, members.limit(0), ["c"], now).count() == 0


def test_recent_first(spark):
    acts = spark.createDataFrame([(1, i, i // 2) for i in range(5)] + [(2, 9, 0)], "user_id long, id long, start_ms long")
    assert sorted((r.user_id, r.id, r.of, r.place) for r in views.recent_first(acts, 3).collect()) == [(1, 2, 5, 1), (1, 3, 5, 2), (1, 4, 5, 3), (2, 9, 1, 1)]
    assert views.recent_first(acts, 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(0, 20) / 4, r.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, True), (1.0, None)], "score double, positive boolean").repartition(4)
    f1 = lambda t: 2 * sum(p for s, p in rows if s >= t) / (sum(s >= t for s, _ in rows) + sum(p for _, p in rows))
    best = min({s for s, _ in rows}, key=lambda t: (-round(f1(t), 9), t))
    x = patterns.threshold_sweep(df, 2.1).first()
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    assert (x.best_score, x.best_f1, x.f1_fixed) == (best, round(f1(best), 6), round(f1(2.1), 6))
    assert (x.pos_mean, x.neg_mean) == (round(sum(pos) / len(pos), 6), round(sum(neg) / len(neg), 6))
    assert patterns.auc(df).first().auc == round(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), 6)
    assert patterns.threshold_sweep(df, 99.0).first().f1_fixed == 0.0
    none = patterns.threshold_sweep(df.limit(0), 1.0).first()
    assert none.best_score is None and none.pos_mean is None


def test_coherence(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 1.0]), (2, 4, [-1.0, -1.0])], "label long, vec_id long, embedding array<double>")
    assert [(r.label, r.coherence, r.members) for r in patterns.coherence(df).collect()] == [(1, 0.70711, 2)]
