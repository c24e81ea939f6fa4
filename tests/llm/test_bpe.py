"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Coder(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_signs(both):
    """Code points after a letter, a digit and a blank: the first 12,288, every 16th of the others, and all that the two libraries class differently."""
    own, library = both
    signs = [chr(c) for c in (*range(0x3000), *range(0x3000, 0x110000, 16)) if not 0xD800 <= c < 0xE000] + sorted(bpe.newer_signs())
    for k in range(0, len(signs), 4096):
        text = "".join(f"a{c}1{c} {c}" for c in signs[k : k + 4096])
        assert own.encode(text) == library.encode_ordinary(text), hex(k)


def test_random_pieces(both):
    own, library = both
    r = random.Random(3)
    for alphabet in ("ab", "aab ", "the nd", "0123", "\n\t ", "äöü€", "猫が好"):
        for _ in range(200):
            text = "".join(r.choices(alphabet, k=r.randint(0, 300)))
            got = own.encode(text)
            assert got == library.encode_ordinary(text), text
            assert own.decode(got) == text.encode()
    assert not own._queue.top and not own._queue.buckets


def test_lower_ranks_after_a_merge():
    """A vocabulary in which a merge makes a pair of a lower rank: those pre-tokens are merged one at a time, as the library does."""
    r = random.Random(9)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        long = [x for x in {"".join(r.choices("abc", k=r.randint(2, 5))).encode() for _ in range(40)}]
        r.shuffle(long)
        tokens |= {x: 256 + i for i, x in enumerate(long)}
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens, special_tokens={})
        pairs, queue = bpe.Pairs(tokens), bpe.RankQueue(max(tokens.values()))
        pieces = ["".join(r.choices("abc", k=r.randint(1, 40))) for _ in range(60)]
        got = bpe.merged_all([x.encode() for x in pieces], tokens, pairs, queue)
        for x, ids in zip(pieces, got, strict=True):
            if x.encode() not in tokens:
                assert ids == library.encode_ordinary(x) == bpe.merged(x.encode(), tokens, queue), x


def test_long_pieces(both):
    """One pre-token of a million signs: letters, and white space, which the library refuses at this length."""
    own, library = both
    r = random.Random(5)
    text = "".join(r.choices("etaoinshr", k=1_000_000))
    got = own.encode(text)
    assert got == library.encode_ordinary(text) and own.decode(got) == text.encode()
    for text in (" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000):
        assert own.decode(own.encode(text)) == text.encode()
    for text in (" " * 50_000, "\n" * 50_000 + "x", "a" * 50_000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_report(docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.report(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(odd, empty):
    assert bpe.report(empty).count() == 0
    assert bpe.encoded(odd, keep=odd.columns).columns == [*odd.columns, "ids"]
    back = bpe.decoded(bpe.encoded(odd, keep=["doc_id", "text", "score"]), keep=["doc_id", "text", "score"])
    assert back.where(F.coalesce("text", F.lit("")).cast("binary") != F.col("bytes")).count() == 0
    assert back.count() == odd.count()
    with pytest.raises(ValueError, match="kept column"):
        bpe.encoded(odd.withColumn("ids", F.lit(1)), keep=["ids"])
