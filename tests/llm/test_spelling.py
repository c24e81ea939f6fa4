"""Spelling variants against all pairs of words: the smallest table, odd rows, and words that share most of their signs."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        all_ = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)]
        count[w] = len(all_)
        best = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n[w], count[w], n[form[w]] if form[w] else -1))
    return sorted(out)


def found(df):
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spelling.report(docs)) == plain(plain_words(rows))


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spelling.report(odd)) == plain(plain_words(rows))
    assert found(spelling.report(empty)) == []


def test_long_runs(spark):
    """Runs of hundreds of thousands of letters, of which some are one edit apart."""
    r = random.Random(1)
    base = "".join(r.choices("abcdefgh", k=200_000))
    texts = [base] * 8 + [base[:7] + base[8:]] * 4 + [base[:150_000] + "z" + base[150_000:]] * 3 + [base + "é"] * 3 + ["x" * 300_000] * 3
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = spelling.grouped(spelling.words(docs, typo_every=0)).collect()
    assert sorted((len(x.word), x.n, x.n_near, len(x.root)) for x in got) == [(199_999, 4, 1, 200_000), (200_000, 8, 3, 200_000), (200_001, 3, 1, 200_000), (200_001, 3, 1, 200_000), (300_000, 3, 0, 300_000)]


def test_crowded_segments(spark, monkeypatch):
    """Thousands of words share their first or last letters; keys are halved until they are small, and nothing is lost."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", 60)
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", 200)
    r = random.Random(2)
    n = {}
    for head in ("konstan", "ab", "zzzzzz"):
        for _ in range(500):
            n[head + "".join(r.choices("abß", k=r.randint(4, 7)))] = r.randint(3, 300)
            n["".join(r.choices("aé", k=r.randint(4, 7))) + head] = r.randint(3, 300)
    n |= {"a" * k: 3 + k for k in range(5, 30)}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = spelling.grouped(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
    assert found(got) == plain(n)


def test_nothing_is_broadcast(spark, monkeypatch):
    """A vocabulary's files may be small, while what is exploded from it is not: no join sends a side through the driver."""
    plans = []

    def seen(df, name="table", held=spelling.cut):
        plans.append(df)
        return held(df, name)

    monkeypatch.setattr(spelling, "cut", seen)
    r = random.Random(3)
    n = {"".join(r.choices("abc", k=r.randint(5, 7))): r.randint(3, 300) for _ in range(400)}
    vocabulary = spelling.cut(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    got = spelling.grouped(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
    assert found(got) == plain(n)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (*plans, got)]
    assert sum("Join" in x for x in plans) >= 4 and not any("Broadcast" in x for x in plans)


def test_one_edit_belongs_to_one_part():
    """Of all ways to divide a word, exactly one part holds the edit."""
    for a in ("aab", "abcab", "aaaa", "a"):
        others = {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for k in (0, 1) for c in ("", "a", "b", "x")}
        for b in others:
            for cuts in ([0, len(a)], *([0, i, len(a)] for i in range(1, len(a)))):
                held = sum(spelling.one_edit(a, b, lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False))
                assert held == near(a, b), (a, b, cuts)
