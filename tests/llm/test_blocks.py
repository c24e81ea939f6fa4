"""Benchmarks of several blocks, spanning links of large groups, long texts of language identification, and clashing columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, simhash


def test_two_blocks_are_one(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "Three"), (901, "one two three " * 400)], "item_id long, text string"))
    rows = docs.select("doc_id", "text").unionByName(docs.where("doc_id = 100008").select("doc_id", "text")).unionByName(spark.createDataFrame([(None, "one two three")], "doc_id long, text string"))
    whole = sorted(map(str, decontaminate.report(rows, bench).collect()))
    assert sorted(map(str, decontaminate.report(rows, bench, block_chars=3000).collect())) == whole
    odd = docs.withColumn("items", F.lit("x")).withColumn("n_words", F.lit(1.5)).withColumn("hit_ranges", F.lit(None).cast("int"))
    one, two = (decontaminate.decontaminated(odd, bench, **o) for o in ({}, {"block_chars": 3000}))
    assert one.dtypes == odd.dtypes and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) != []


def test_spanning_links_connect_the_same(spark):
    rng = random.Random(1)
    fps = {0}
    while len(fps) < 300:  # chains of near values around a few centres
        fps.add(rng.choice(sorted(fps)[-9:]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if rng.random() < 0.9 else rng.getrandbits(64))
    fp = np.array(sorted(fps), np.uint64)

    def parts(pairs):
        root = {int(x): int(x) for x in fp}
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = {}
        for x in root:
            y = x
            while root[y] != y:
                y = root[y]
            out[x] = y
        return out

    every = [(int(a), int(b)) for a in fp for b in fp if a < b and int(a ^ b).bit_count() <= 3]
    some = [(int(a), int(b)) for x, y in simhash.spanning_links(fp) for a, b in zip(x, y, strict=True)]
    assert len(fp) > simhash._PAIRWISE and parts(every) == parts(some) and all(int(a ^ b).bit_count() <= 3 for a, b in [(np.uint64(p), np.uint64(q)) for p, q in some])


def test_long_text_has_the_same_language(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"the by this with of reading and " * 400, b"sich auf und der die mit ein von " * 400]
    model = langid.Model([["en"], ["de"]], [(-1, 0, 1)], rng.normal(0, 1, (langid.DIMS, 1)).astype(np.float32), np.zeros(1))
    whole = model.margins(texts)
    monkeypatch.setattr(langid, "LONG", 1000)
    assert np.allclose(model.margins(texts), whole, atol=0.01)
