"""Each operator's query against a plain version over the smallest table and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprint, langid, licenses, lm, pack, passages, pii, quality, simhash


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(docs):
    got = defaultdict(list)
    for r in pii.report(docs).collect():
        got[r.doc_id].append(r)
    for i, text in rows_of(docs):
        r, want = got[i].pop(), base_spans(text)
        n = Counter(s[3] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PLAIN), (i, text[:200])
        names = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert r.base_sha256 == sha(",".join(names)), (i, names, r.spans)
        assert set(names) <= set(r.spans.split(",")) | {""}
        if not re.search("[0-9@]", text):
            assert r.spans == ""
    assert not any(got.values())


def test_pii_redaction(docs, odd, empty):
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    for i, text in rows_of(docs):
        left = out[i].text or ""
        assert not base_spans(left), (i, left[:300])
        if not re.search("[0-9@]", text):
            assert left == text
    assert pii.redacted(odd).columns == odd.columns
    assert pii.report(empty).count() == 0


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@x{i}.org" for i in range(3000))
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 3000 and r.base_sha256 == sha(",".join(f"email:{a}:{b}" for a, _, b, _ in base_spans(text)))


def test_decontamination(docs, spark, sf_dir):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "Three"), (901, None), (902, "!!")], "item_id long, text string"))
    windows = defaultdict(set)
    for r in bench.collect():
        w = word.findall((r.text or "").translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    got = defaultdict(list)
    for r in decontaminate.report(docs, bench).collect():
        got[r.doc_id].append(r)
    lengths = {len(k) for k in windows}
    for i, text in rows_of(docs):
        w, hit, items = word.findall(text.translate(low)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= own
        r = got[i].pop()
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == sha(",".join(sorted(map(str, items))))


def test_fingerprints(docs):
    rows = sorted(rows_of(docs.dropDuplicates(["doc_id"])))
    got = {r.doc_id: r for r in fingerprint.report(docs.dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(rows)
    prints = {}
    apart = []
    for k, (i, text) in enumerate(rows):
        r, h = got[i], len(text) // 2
        edited = text[: len(text) - h] + rows[(k + 1) % len(rows)][1][:h]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited)), i
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
        elif len(text) > 400:
            apart.append(r.near_edited - r.near_next)
    assert len(set(prints.values())) == len(prints)
    assert sorted(apart)[len(apart) // 10] > 0.1


def test_fingerprint_arithmetic(spark):
    rows = [("ab", "x y z\nu v"), ("ba", "u v\nx y z"), ("a", "x y z"), ("b", "u v"), ("c", "x y q")]
    v = fingerprint.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"]).groupBy().pivot("k", ["ab", "ba", "a", "b", "c"]).agg(F.first("v"))
    r = v.select((F.col("ab") == F.col("ba")).alias("order"), (fingerprint.added(F.col("a"), F.col("b")) == F.col("ab")).alias("add"), (fingerprint.removed(F.col("ab"), F.col("b")) == F.col("a")).alias("sub"), (F.col("a") == F.col("c")).alias("other")).first()
    assert (r.order, r["add"], r["sub"], r.other) == (True, True, True, False)


def test_fingerprint_odd_rows(odd, empty):
    assert fingerprint.report(odd).count() == odd.count()
    assert fingerprint.report(empty).count() == 0
    assert fingerprint.report(odd.limit(1)).first().near_next == 1


def test_language(docs, odd, empty):
    got = langid.report(docs).collect()
    truth = {r.doc_id: r for r in docs.collect()}
    own = [r for r in got if r.held_out and r.doc_id < 100_000 and truth[r.doc_id].lang]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in own) > 0.95 * len(own)
    for r in got:
        text = truth[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
    kept = langid.identified(odd)
    assert kept.columns == odd.columns and langid.identified(empty).count() == 0
    assert langid.report(empty).count() == 0


def test_quality(docs, spark, sf_dir, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = {r.doc_id: r for r in quality.report(big, labels).collect()}
    own = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    right = {q: [g.predicted == q for g, y in own if y == q] for q in (0, 1)}
    assert all(sum(x) > 0.85 * len(x) for x in right.values()), {q: sum(x) / len(x) for q, x in right.items()}
    small = quality.report(docs, labels).collect()
    assert len(small) == docs.count()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in small)
    assert quality.report(empty, labels).count() == 0
    assert quality.report(docs, labels.limit(0)).count() == len(small)


def test_language_model(docs, empty):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    token = re.compile(r"[^\x20\x09-\x0D]+")
    rows = rows_of(docs)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = [(i, [*token.findall(t.translate(low)), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in lm.report(docs).collect():
        got[r.doc_id].append(r)
    better = 0
    for i, ws in tokens:
        r = got[i].pop()
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0
        better += held[i] and r.score > r.base_score
    assert better > 0.7 * sum(held[i] for i, _ in rows)
    assert lm.report(empty).count() == 0


def test_packing(docs, odd, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = docs.where("doc_id < 60 or doc_id > 99999")
    want = Counter((i, tuple([*tok.encode(t, add_special_tokens=False).ids, 1])) for i, t in rows_of(some))
    got = pack.report(some).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for (i, ids), n in want.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in by[i])
        pieces = Counter(own)
        assert all(k % n == 0 for k in pieces.values()) or n > 1
        if n == 1:
            at = 0
            for start, length, crc in own:
                assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
        assert sum(r.length for r in by[i]) == n * len(ids) and all(r.doc_tokens == len(ids) for r in by[i])
    full = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        full += at == 2048
    assert full >= len(seqs) - 1
    assert pack.report(odd).select("doc_id").distinct().count() == 11 and pack.report(empty).count() == 0


def test_packing_plan():
    import numpy as np

    h = np.zeros(2048, np.int64)
    h[[512, 1536, 700, 648, 1, 2047]] = [5, 3, 4, 2, 7, 2]
    combos = pack.combinations()
    n = pack.repeats(h, combos)
    used = np.bincount(combos.ravel(), np.repeat(n, 3), 2048).astype(int)
    used[0] = 0
    assert (used <= h).all() and (combos.sum(1) == 2048).all()
    assert used[1536] == 3 and used[2047] == 2


def fp_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, odd, empty):
    rows = rows_of(docs)
    fps = [fp_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i)
    want = sorted((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in simhash.report(docs).collect()) == want
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and simhash.report(empty).count() == 0


def test_passages(docs, odd, empty, spark):
    body = " ".join(f"w{i % 37}{i}" for i in range(60))
    more = spark.createDataFrame([(200_001, f"a {body} b"), (200_000, f"{body} {body}"), (200_002, " ".join(body.split()[5:24])), (200_003, " ".join(body.split()[5:25]))], "doc_id long, text string")
    rows_df = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).unionByName(more)
    rows = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows_of(rows_df))
    seen, want = set(), {}
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone |= set(range(k, k + 20))
            seen.add(x)
        want[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    for batches in (1, 3):
        got = passages.cleaned(rows_df, batches=batches).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("k")).collect()
        assert len(got) == len(want)
        assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert passages.report(odd).count() == odd.count() and passages.report(empty).count() == 0


def test_licenses(spark, docs, odd, empty):
    files = spark.createDataFrame(
        [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.txt", "nothing here"), ("a/b/c/y.txt", "Hello.\nReleased under the MIT License.\n"), ("z.txt", "This license of ours is the moon"), (None, "x"), ("a/q.txt", None)],
        "path string, text string",
    )
    own = licenses.matches(files)
    assert {r.path: r.license for r in own.collect()} == {"a/LICENSE": "Apache-2.0", "a/b/c/y.txt": "MIT"}
    grants = own.where("path like '%LICENSE'").select(licenses.directory(F.col("path")).alias("directory"), "license")
    got = {r.path: (r.license, r.origin) for r in licenses.inherited(files.select("path"), own, grants).collect()}
    assert got == {"a/LICENSE": ("Apache-2.0", "own"), "a/b/x.txt": ("Apache-2.0", "directory:a"), "a/b/c/y.txt": ("MIT", "own"), "z.txt": (None, "none"), None: (None, "none"), "a/q.txt": ("Apache-2.0", "directory:a")}
    names = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
    texts = dict(rows_of(docs))
    for r in licenses.report(docs).collect():
        said = {v for k, v in names.items() if k in texts[r.doc_id]}
        assert (r.origin == "own") == bool(said) and (not said or r.license in said)
    assert licenses.report(odd).count() == odd.count() and licenses.report(empty).count() == 0
