"""The log of passage windows: batches over several sessions, and compaction, by their results."""

import random

from tidemark.llm import passages


def plain(rows, width=20):
    """Words at which a window starts that starts earlier too, by document."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = text.split()
        at = []
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            at += [k] * (x in seen)
            seen.add(x)
        if at:
            out[i] = at
    return out


def texts():
    rng = random.Random(4)
    common = [" ".join(rng.choices("abcdefghijklmnop", k=45)) for _ in range(4)]
    return [(i, " ".join([*rng.choices("qrstuvwxyz", k=rng.randrange(0, 60)), rng.choice(common), *rng.choices("qrstuvwxyz", k=9)])) for i in range(120)]


def test_log_over_sessions(spark, tmp_path):
    rows, path = texts(), str(tmp_path / "log")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, sizes = {}, []
    for k, session in enumerate([spark, spark.newSession(), spark.newSession(), spark]):
        log = passages.FingerprintLog.open(session, path) if k else passages.FingerprintLog(session, path)
        lo, hi = 30 * k, 30 * k + 30
        docs_ = session.createDataFrame(rows[lo:hi], docs.schema)
        marks = log.add(passages._keyed(docs_, "doc_id", "text"), lo - 1 if k else None)
        got |= {r.id: sorted(r["at"]) for r in marks.collect()}
        sizes.append([level for level, _ in log.runs])
    assert sizes == [[0], [1], [1, 0], [2]]
    assert got == plain(rows)
    held = log._run(log.runs[0][1])
    want = passages.anchors(passages._keyed(docs, "doc_id", "text"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.collect()))


def test_rows_without_ids(spark):
    rows = [(None, "a b " * 20), (None, "c d " * 20), (1, "c d " * 20), (1, "c d " * 20), (2, None)]
    got = passages.cleaned(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 40, 38), (0, 40, 38), (1, 40, 40), (1, 40, 40), (2, 0, 0)]
