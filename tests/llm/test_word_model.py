"""The word model: probabilities add up to one, training sees all texts and learns what follows what."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lm


def test_probabilities_of_all_words_add_up(spark, docs):
    counts = lm.counted(docs).cache()
    model = lm.fitted(docs, counts)
    u = model.units
    n = len(u.hot)
    every = np.arange(n + lm.BUCKETS)
    rows = [(r.token.encode(), r.c) for r in counts.collect()]
    cold = [(w, c, int(u.ids([w])[0])) for w, c in rows if w not in u.hot]
    for pair in (0, 777, u.start * lm.CONTEXTS + u.start, lm.CONTEXTS**2 - 1):
        p = 10 ** model.log10(np.full(len(every), pair), every)
        assert abs(p.sum() - 1) < 1e-3
        shares = np.zeros(lm.BUCKETS)
        for _, c, k in cold:
            shares[k - n] += (c + 0.1) / 10 ** u.bucket_log[k - n]
        unseen = 0.1 / 10**u.bucket_log
        assert np.allclose(shares + unseen, 1)


def test_all_texts_train(spark):
    """Tokens that the rounds and tasks have met are those of all texts, and a word that only follows one other is told by it."""
    rows = [(i, " ".join(["alpha beta gamma", "delta beta epsilon"][i % 2] for _ in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    counts = lm.counted(docs).cache()
    u = lm.units(counts)
    assert u.count.sum() == 600 * (40 * 3 + 1) == counts.agg(F.sum("c")).first()[0]
    model = lm.Model(u, bilinear := lm.train(docs, u), lm.log_sums(bilinear, spark))
    words = [b"alpha", b"beta", b"gamma"]
    ids = u.ids(words)
    c = u.contexts(words, ids)
    after = {w: float(model.log10(np.array([c[0] * lm.CONTEXTS + c[1]]), u.ids([w]))[0]) for w in (b"gamma", b"epsilon")}
    assert after[b"gamma"] > after[b"epsilon"] + 0.1


def test_common_words_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1), ("x" * 70, 99)], "token string, c bigint")
    u = lm.units(counts)
    assert set(u.hot) == {b"a"} and u.count.sum() == 124
