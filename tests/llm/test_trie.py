"""Prefix tries against a plain version: the given table, odd rows, one opening that most conversations share, long chains."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, block=20, heads=4, splice=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads if splice else 0
        path = tuple(own.get(c - c % block, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else -1, len(w), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, w in members.items())


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.dtypes == [(x, "string" if x == "ends_sha256" else "bigint") for x in names]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


ODD = [
    (0, 0, "user", "a b"), (0, 1, None, "c"), (0, None, "user", None), (1, 0, "user", "a b"), (1, 1, "bot", "a b"), (2, 0, "user", ""), (3, 5, None, None), (21, 0, "user", "\x0b x\ty z "),
    (22, 0, "user", "x"), (22, 1, "use", "rx"), (40, 0, "user", "a b"), (41, 0, "user", "a b"), (41, 1, "user", "a b"), (41, 2, "user", "a b"), (41, 3, "user", "a b"), (None, 0, "user", "a b"), (60, 0, "user", "word " * 50_000),
]


def test_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(trie.report(turns)) == plain(map(tuple, turns.select("conv_id", "turn", "role", "text").collect()))


def test_odd_rows(spark):
    turns = spark.createDataFrame(ODD, SCHEMA).withColumn("words", F.lit("extra")).withColumn("seq", F.lit(1)).repartition(3)
    assert found(trie.report(turns)) == plain(ODD)
    assert found(trie.report(turns.limit(0))) == []


def test_all_turnless(spark):
    """Conversations lose their first turns, and there is none to take them from."""
    rows = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = found(trie.report(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and len(got) == 1


@pytest.mark.parametrize("most", [5, 40, 1000])
def test_shared_openings(spark, most):
    """Most conversations begin alike and part at various depths, copies among them, so their first turn is dealt again and again."""
    rows = []
    for c in range(400):
        long = ["hello", "again", "and again", f"topic {c % 3}"] + ["more"] * (c % 7) + [f"end {c % 50}"]
        rows += [(c, t, "user", x) for t, x in enumerate(long if c % 4 else [f"own {c % 11}", "x"])]
    rows += [(1000, t, "user", f"step {t}") for t in range(300)] + [(1001, t, "user", f"step {t}") for t in range(200)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(trie.prefix_trie(trie.conversations(turns), most)) == plain(rows, splice=False)


def test_no_group_grows_with_a_first_turn(spark, monkeypatch):
    """What one task gets stays below the bound, though all conversations share their first two turns."""
    rows = [(c, t, "user", x) for c in range(600) for t, x in enumerate(["same", "same too", f"a {c % 40}", f"b {c}"])]
    convs = trie.conversations(spark.createDataFrame(rows, SCHEMA))
    seen, real = [], trie._dealt

    def dealt(rows, load, most):
        seen.append(rows.groupBy("key").agg(F.sum(F.size("path") - F.col("depth") + 1).alias("n")).agg(F.max("n")).first()[0])
        return real(rows, load, most)

    monkeypatch.setattr(trie, "_dealt", dealt)
    assert found(trie.prefix_trie(convs, 50)) == plain(rows, splice=False)
    assert seen == [None, 30]
