"""Average linkage against greedy merging of the best pair, in one task and in rounds; merges, evictions and splits by plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linkage

SCHEMA = "vec_id long, embedding array<double>"


def greedy(ids, vectors, threshold):
    """The best pair of groups first, by means over all pairs of members."""
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in zip(ids, vectors, strict=True) if v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    groups = [[i] for i in sorted(x)]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                s = round(float(np.mean([x[i] @ x[j] for i in groups[a] for j in groups[b]])), 11)
                if s >= threshold and (best is None or s > best[0]):
                    best = (s, a, b)
        if best is None:
            return sorted([sorted(g) for g in groups] + [[i] for i in ids if i not in x])
        groups[best[1]] += groups.pop(best[2])


def groups_of(df, id_col="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r["root"], []).append(r[id_col])
    assert all(min(g) == root for root, g in out.items())
    return sorted(sorted(g) for g in out.values())


def u(angle):
    return [math.cos(angle), math.sin(angle)]


def test_rules(spark):
    step, close = math.acos(0.8), math.acos(0.95)
    cases = [
        ([u(0), u(step), u(2 * step), [0.0, -1.0]], [[0, 1], [2], [3]]),  # a bridge at the border joins nothing on average
        ([u(0), u(close), u(2 * close)], [[0, 1, 2]]),
        ([[1.0, 0.0], [0.0, 1.0]], [[0], [1]]),
        ([[2.0, 0.0], [3.0, 3.0]], [[0], [1]]),
        ([u(0), [math.nan, math.nan], u(close), [0.0, 0.0], None, [1.0], [math.inf, 0.0]], [[0, 2], [1], [3], [4], [5], [6]]),
    ]
    for vectors, want in cases:
        df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
        assert groups_of(linkage.average_linkage(df, [], 0.75)) == want
    assert linkage.average_linkage(spark.createDataFrame([], SCHEMA), [], 0.75).count() == 0
    with pytest.raises(ValueError, match="above zero"):
        linkage.average_linkage(df, [], 0.0)


def vectors(seed, n, dims=6, around=5, spread=0.5):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(around, dims))
    return [(int(i), (mid[i % around] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


def test_chain_is_greedy():
    for seed in range(12):
        rows = vectors(seed, 40, spread=0.3 + 0.1 * seed)
        x = np.array([v for _, v in rows])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for threshold in (0.3, 0.65, 0.9):
            got = linkage.chain_groups(x, np.ones(len(x)), threshold)
            assert sorted(got) == greedy([i for i, _ in rows], [v for _, v in rows], threshold)


@pytest.mark.parametrize("most,block", [(6, 9)])
def test_large_keys(spark, monkeypatch, most, block):
    """Keys too large for a task: parts by links, merged in rounds; copies of vectors are ties."""
    monkeypatch.setattr(linkage, "BLOCK", block)
    rows = vectors(3, 26) + [(100 + i, v) for i, v in vectors(3, 4)]
    df = spark.createDataFrame([(k, *r) for k in ("a", None) for r in rows], "k string, vec_id long, embedding array<double>")
    got = linkage.average_linkage(df, ["k"], 0.65, most=most)
    want = greedy([i for i, _ in rows], [v for _, v in rows], 0.65)
    assert groups_of(got.where("k = 'a'")) == want == groups_of(got.where("k is null"))


def test_copies_take_no_rounds(spark, monkeypatch):
    """Equal vectors are one group from the start, however many there are: a key of few different ones is one task's."""
    monkeypatch.setattr(linkage, "_in_rounds", None)
    base = vectors(5, 8)
    rows = [(100 * k + i, v) for k in range(9) for i, v in base] + [(1000, [0.0] * 6)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, vec_id long, embedding array<double>").repartition(5)
    want = greedy([i for i, _ in rows[:-1]], [v for _, v in rows[:-1]], 0.65) + [[1000]]
    assert groups_of(linkage.average_linkage(df, ["k"], 0.65, most=10)) == want


@pytest.mark.parametrize("kind", ["spread", "copied", "template"])
def test_lists_leave_no_doubt(monkeypatch, kind):
    """Rounds of short lists merge what the whole matrix merges: spread vectors, many near copies of a few, and one template that is everyone's nearest."""
    r = np.random.default_rng(4)
    x = {"spread": r.normal(size=(900, 16)), "copied": np.repeat(r.normal(size=(12, 16)), 70, 0) + 0.2 * r.normal(size=(840, 16)), "template": np.vstack([np.ones(64), np.ones(64) + 0.2 * r.normal(size=(600, 64))])}[kind]
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(linkage, "MATRIX", 3)
    monkeypatch.setattr(linkage, "LISTED", 9)
    for threshold in (0.3, 0.65, 0.9):
        root = linkage.linked_groups(x, np.ones(len(x)), threshold)
        assert sorted([*np.flatnonzero(root == i)] for i in set(root)) == sorted(linkage.chain_groups(x, np.ones(len(x)), threshold))


def test_rounds_are_few(spark, monkeypatch):
    """A key of many tasks needs a few rounds of jobs, whose lists are compared in blocks and merged in several tasks."""
    monkeypatch.setattr(linkage, "LIST_BLOCK", 150, raising=False)
    monkeypatch.setattr(linkage, "MOST_LISTED", 260, raising=False)
    x = np.random.default_rng(6).normal(size=(700, 12))
    df = spark.createDataFrame([(k, i, v.tolist()) for k, lo, hi in (("a", 0, 600), ("b", 500, 700)) for i, v in enumerate(x) if lo <= i < hi], "k string, vec_id long, embedding array<double>").repartition(3)
    spark.sparkContext.setJobGroup("rounds", "rounds")
    got = spark.createDataFrame(linkage.average_linkage(df, ["k"], 0.5, most=20).collect(), "k string, vec_id long, root long")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k, lo, hi in (("a", 0, 600), ("b", 500, 700)):
        assert groups_of(got.where(F.col("k") == k)) == sorted([lo + i for i in g] for g in linkage.chain_groups(x[lo:hi], np.ones(hi - lo), 0.5))
    assert jobs < 150, jobs


def test_queries_by_label(spark, sf_dir):
    """Whole labels of the table."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 3")
    got = linkage.average_linkage(table, ["label"], 0.25)
    for label in range(3):
        rows = table.where(F.col("label") == label).collect()
        assert groups_of(got.where(F.col("label") == label)) == greedy([r.vec_id for r in rows], [list(map(float, r.embedding)) for r in rows], 0.25)


def test_clusters(spark):
    rows = [(1, 10, [1.0, 0.0]), (1, 11, [0.9, 0.1]), (1, 12, [-0.2, 1.0]), (2, 20, [0.0, 1.0]), (2, 21, None), (3, 30, [1.0, 0.05]), (3, 31, [0.0, 0.0]), (4, 40, [1.0, 1.0]), (4, 41, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "label long, vec_id long, embedding array<double>")
    means = {r.label: r.mean for r in linkage.mean_vectors(df, "label").collect()}
    assert means[4] is None and means[2] == [0.0, 1.0] and abs(np.linalg.norm(means[1]) - 1) < 1e-12
    sims = linkage.member_likeness(df, "label")
    got = {r.vec_id: r.sim for r in sims.collect()}
    assert got[21] is None and got[31] is None and got[40] is None and abs(got[20] - 1) < 1e-12
    assert [r.vec_id for r in linkage.evicted(sims, "label").collect()] == [12]
    assert [r.label for r in linkage.incoherent(sims, "label").collect()] == [1]
    touched, none = spark.createDataFrame([(3,)], "label long"), spark.createDataFrame([], "a long, b long")
    assert [(r.a, r.b) for r in linkage.merge_candidates(linkage.mean_vectors(df, "label"), "label", touched, none).collect()] == [(1, 3)]
    assert linkage.merge_candidates(linkage.mean_vectors(df, "label"), "label", touched, spark.createDataFrame([(1, 3)], "a long, b long")).count() == 0
    parts = {r.vec_id: r.part for r in linkage.resplit(df, "label").collect()}
    assert parts == {10: None, 11: None, 12: 12, 20: None, 21: None, 30: None, 31: None, 40: None, 41: 41}


def test_merge_candidates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 9)
    rows = vectors(7, 60)
    means = spark.createDataFrame([(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows], "label long, mean array<double>")
    touched = means.where("label % 7 = 0").select("label")
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = sorted((-round(float(x[a] @ x[b]), 12), a, b) for a in x for b in x if a < b and (a % 7 == 0 or b % 7 == 0) and x[a] @ x[b] >= 0.55)
    declined = [(a, b) for _, a, b in want[:3]]
    got = linkage.merge_candidates(means, "label", touched, spark.createDataFrame(declined, "a long, b long")).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in want[3:18]]
