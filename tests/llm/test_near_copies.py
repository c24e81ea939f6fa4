"""The pipeline's near-duplicate stage against brute force: edited copies, and rows that repeat."""

import random

import numpy as np
import pytest

from tidemark.llm import simhash


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_deduplicated(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(60):
        base = rng.choices(words, k=rng.choice([40, 120, 400]))
        rows.append((len(rows), " ".join(base)))
        for edits in range(6):
            own = list(base)
            for at in rng.sample(range(len(own)), edits * len(own) // 100):
                own[at] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    # 80 near copies of one text, and texts that share one long passage but are different
    passage = rng.choices(words, k=100)
    rows += [(1000 + k, " ".join([*passage, f"x{k}"])) for k in range(80)]
    rows += [(1200 + k, " ".join([*passage, *rng.choices(words, k=45)])) for k in range(80)]
    rows += [(2000, "a b"), (2001, "A  b"), (2002, "a b c"), (2003, ""), (2004, None), rows[8], rows[8], (5, "other text of id five with more words"), (5, rows[0][1])]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t or "") for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    docs = spark.createDataFrame([(*r, "s") for r in [*rows, (None, "a b"), (None, "a b")]], "doc_id long, text string, source string").repartition(5)
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(map(min, groups.values()))
    assert kept.count(None) == 2


@pytest.mark.parametrize(("one", "other", "both"), [(8, 10, 8), (9, 9, 8), (20, 25, 20), (90, 90, 80), (450, 450, 400)])
def test_anchors_find_a_similarity_of_0_8(one, other, both):
    """The stage's fingerprints: a pair shares an anchor and has few differing bits, unrelated sets do not."""
    rng, k = np.random.default_rng(5), 1000
    all_ = rng.permuted(rng.integers(0, 1 << 63, (k, one + other - both), np.uint64) * np.uint64(2), axis=1)
    a = simhash.wide_fingerprints([np.sort(x[:one]) for x in all_])
    b = simhash.wide_fingerprints([np.sort(x[one - both :]) for x in all_])
    far = lambda x, y: np.bitwise_count(x[:, :2] ^ y[:, :2]).sum(1)
    same = (simhash.block_anchors(a) == simhash.block_anchors(b)).sum(1)
    assert ((far(a, b) <= simhash.FAR) & (same > 0)).mean() > 0.998
    assert (far(a, np.roll(b, 1, 0)) <= simhash.FAR).mean() < 0.002
    assert 0.49 < np.unpackbits(a.view(np.uint8)).mean() < 0.51


def test_bits_are_those_of_most_shingles():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 3, 255, 257, 1025)]
    got = simhash.wide_fingerprints(sets)
    for x, row in zip(sets, got, strict=True):
        for k in (0, 19):
            bits = np.unpackbits(simhash.mix(x ^ simhash._SALTS[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int).sum(0)
            assert (np.unpackbits(row[k : k + 1].view(np.uint8), bitorder="little") == (2 * bits > len(x))).all()


@pytest.mark.parametrize("size", [600, 1500])
def test_clusters_of_small_and_large_groups(size):
    """Rows with 16 differing bits are told from the others, in groups compared at once and in larger ones (a seed without chance hits)."""
    rng, k = np.random.default_rng(15), size // 3
    fp = rng.integers(0, (1 << 64) - 1, (size, 2), np.uint64)
    fp[-k:] = fp[:k] ^ np.uint64(0xFFFF00000)
    n = np.full(size, 100)
    n[-k : -k + 50] = 79
    assert {tuple(sorted(x.tolist())) for x in simhash.clusters(n, fp, 0.8)} == {(i, size - k + i) for i in range(50, k)}


def test_texts_of_eight_and_nine_words(spark):
    words = np.random.default_rng(8).integers(0, 10**9, (3000, 9)).tolist()
    rows = [(2 * k, " ".join(map(str, w[:8]))) for k, w in enumerate(words)] + [(2 * k + 1, " ".join(map(str, w))) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == list(range(0, 6000, 2))


def test_bands_of_a_large_group_hang_on_few_hubs(spark):
    """Of 600 near copies each comes once for a hub, not once for every anchor, and bands keep what shares an anchor together."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(170)]
    rows = [(k, k, " ".join(f"x{k}" if i in own else w for i, w in enumerate(base))) for k in range(600) for own in [rng.sample(range(170), 3)]]
    sets = simhash.shingle_sets(spark.createDataFrame(rows, "__uid long, doc_id long, text string").repartition(4), "doc_id", "text", 5)
    found = [tuple(r) for r in simhash.bands_of(sets, 0.8)[0].collect()]
    assert len(found) < 36 * 600
    assert {r[1] for r in found} | {r[0] for r in found} == set(range(600))
    assert len({r[:2] for r in found}) == len(found) and all(r[0] < r[1] for r in found)
