"""Search for many queries at once, by plain versions: blocks of queries, ties, odd vectors, terms that nobody has."""

import math

import numpy as np

from tidemark.operators import search


def test_nearest(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(0, 3, 4).astype(float).tolist()) for i in range(150)] + [(900, None), (901, [math.nan] * 4), (902, [1.0]), (903, [None, 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([*rows, (None, [0.0] * 4)], "vec_id long, embedding array<double>").repartition(5)
    for block, size in ((2048, 2000), (7, 16)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "ROWS", size)
        got = search.nearest_of_each(vectors, vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 12).collect()
        want = []
        for q, v in rows[:150:10]:
            near = sorted((round(math.dist(v, x), 6), i) for i, x in rows[:150])[:12]
            want += [(q, i, d, k + 1) for k, (d, i) in enumerate(near)]
        assert sorted(map(tuple, got)) == sorted(want)
    odd = vectors.where("vec_id >= 900").withColumnRenamed("vec_id", "query_id")
    assert [(x.query_id, x.vec_id) for x in search.nearest_of_each(vectors, odd, 3).collect()] == [(902, 902)]
    assert search.nearest_of_each(vectors.limit(0), odd, 3).count() == 0 == search.nearest_of_each(vectors, odd.limit(0), 3).count()


def test_products_are_of_bounded_size(spark, monkeypatch):
    """Many queries at once, ties among copies, products of a few queries by a few vectors: a task keeps the limit best and no more."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2, (40, 5)).astype(float)
    rows = [(int(i), base[i % 40].tolist()) for i in r.permutation(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(search, "ROWS", 16)
    monkeypatch.setattr(search, "ASKED", 7)
    asked = vectors.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, search.nearest_of_each(vectors, asked, 12).collect()))
    place = dict(rows)
    assert got == sorted((q, i, d, k + 1) for q in range(0, 300, 5) for k, (d, i) in enumerate(sorted((round(math.dist(place[q], v), 6), i) for i, v in rows)[:12]))
    names, matrix = np.arange(300), np.array([place[i] for i in range(300)])
    found = search._nearest_in_tasks(vectors.coalesce(1), names, matrix, 12, "vec_id", "embedding", "query_id bigint, vec_id bigint, distance double")
    assert found.count() == 300 * 12


def test_words_that_nobody_asks_for_are_not_shuffled(spark, monkeypatch):
    """Asked terms are told exactly, also where hashes of few bits let others pass; what is shuffled are terms that pass."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w5"), (1, "w7"), (2, "w96")], "query_id long, term string")
    want = sorted(map(tuple, search.bm25_of_each(docs, queries, 5).collect()))
    plan = search.bm25_of_each(docs, queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert want and "LeftSemi, (place" in plan
    for few in (1, 4):
        monkeypatch.setattr(search, "TERM_HASHES", few)
        assert sorted(map(tuple, search.bm25_of_each(docs, queries, 5).collect())) == want


def test_bm25(spark):
    texts = ["a b c", "A b", "b b b d", None, "", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (1, "B"), (1, "b"), (2, "zzz"), (3, "d"), (3, "e")], "query_id long, term string")
    words = [[w for w in (t or "").lower().split()] for t in texts]
    mean, want = sum(map(len, words)) / len(words), []
    for q, asked in ((1, {"a", "b"}), (3, {"d", "e"})):
        scores = {}
        for t in asked:
            df = sum(t in w for w in words)
            for i, w in enumerate(words):
                if t in w:
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want += [(q, i, round(s, 6), k + 1) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:2])]
    assert sorted(map(tuple, search.bm25_of_each(docs, queries, 2).collect())) == sorted(want)


def test_fusion(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 9, 1)], "query_id long, id long, rank int")
    fused = {(r.query_id, r.id): (r.score, r["rank"]) for r in search.fused_of_each([one, two], 2).collect()}
    assert fused == {(1, 11): (round(1 / 62 + 1 / 61, 8), 1), (1, 10): (round(1 / 61, 8), 2), (2, 10): (round(1 / 61, 8), 1), (3, 9): (round(1 / 61, 8), 1)}
    assert sorted((r.query_id, r["rank"], r.id) for r in search.hybrid_of_each(one, two, 3).collect()) == [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 9)]
