"""Byte-level BPE by a rank queue: encoding and decoding with a file of ranks.

A pre-token's bytes form a linked list. Every pair of neighbours that the vocabulary knows stands in the bucket of its rank; which buckets
hold anything is told by a bitmap of three levels, so the next rank is found by three find-first-set steps, however long the pre-token. A
bucket gives its leftmost place first. Entries whose pair has changed since are stale and skipped.

All new pre-tokens of a batch share one queue, and so does a pre-token of any length: a bucket's places are merged at once (of places that
overlap every other one, from the left). That is the order of single merges as long as merges make pairs of higher ranks only. A pre-token in
which one makes a lower rank is done again, one merge at a time. Texts are independent of one another: one pass, no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, ddl, texts_of, with_columns

#: Ids of so many pre-tokens are kept by a worker before it starts afresh; longer pre-tokens than this many signs aren't kept.
KEPT, KEPT_SIGNS = 1 << 17, 48
#: Texts of so many bytes are divided into pre-tokens at a time.
TEXT_BYTES = 4 << 20


class RankQueue:
    """Which ranks have a bucket, by three levels of bitmaps, and the buckets. It ends empty, and is used again."""

    def __init__(self, ranks: int) -> None:
        self.leaf, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The rank's bucket, a new one where it has none."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = []
            word, block = rank >> 6, rank >> 12
            self.leaf[word] |= 1 << (rank & 63)
            self.mid[block] |= 1 << (word & 63)
            self.top |= 1 << block
        return bucket

    def first(self) -> int:
        """The least rank that has a bucket; the queue mustn't be empty."""
        block = (self.top & -self.top).bit_length() - 1
        word = self.mid[block]
        word = (block << 6) + (word & -word).bit_length() - 1
        bits = self.leaf[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> list:
        """Takes the rank's bucket out."""
        word, block = rank >> 6, rank >> 12
        self.leaf[word] &= ~(1 << (rank & 63))
        if not self.leaf[word]:
            self.mid[block] &= ~(1 << (word & 63))
            if not self.mid[block]:
                self.top &= ~(1 << block)
        return self.buckets.pop(rank)


def merged(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token, one merge at a time."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at: list[int] = [-1] * n  # rank of the pair that begins at a place
    get, bucket_of = ranks.get, queue.bucket

    def put(i: int, rank: int | None) -> None:
        at[i] = -1 if rank is None else rank
        if rank is not None:
            heappush(bucket_of(rank), i)

    for i in range(n - 1):
        put(i, get(piece[i : i + 2]))
    while queue.top:
        rank = queue.first()
        bucket = queue.buckets[rank]
        i = heappop(bucket)
        if not bucket:
            queue.drop(rank)
        if at[i] != rank:
            continue  # stale
        gone = after[i]
        end = after[gone]
        after[i], at[gone], at[i] = end, -1, -1
        if end < n:
            before[end] = i
            put(i, get(piece[i : after[end]]))
        if before[i] >= 0:
            put(before[i], get(piece[before[i] : end]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """Ranks of pairs of tokens, of which the vocabulary has what they make together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self._keys = np.append(np.array(keys, np.int64)[order], np.int64(np.iinfo(np.int64).max))
        self._values = np.append(np.array(values, np.int64)[order], -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = a << 32 | b
        i = np.searchsorted(self._keys, key)
        return np.where(self._keys[i] == key, self._values[i], -1)


def merged_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs, queue: RankQueue) -> list[list[int]]:
    """Ids of many pre-tokens, none of which is empty."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(x) for x in pieces])
    starts = np.cumsum(lengths) - lengths
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    token, n = byte_ids[data], len(data)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[starts + lengths - 1], before[starts] = -1, -1
    inner = np.flatnonzero(after >= 0)
    at = np.full(n, -1)
    at[inner] = pairs.ranks(token[inner], token[inner + 1])
    odd: set[int] = set()

    def put(places: np.ndarray) -> None:
        rank = at[places]
        places, rank = places[rank >= 0], rank[rank >= 0]
        if len(places) > 1:
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                queue.bucket(r).append(part)
        elif len(places):
            queue.bucket(int(rank[0])).append(places)

    put(inner)
    while queue.top:
        rank = queue.first()
        parts = queue.drop(rank)
        place = np.concatenate(parts)
        place = np.unique(place[at[place] == rank])  # the others are stale
        if len(place) > 1:
            touch = after[place[:-1]] == place[1:]
            if touch.any():
                i = np.arange(len(place))
                begins = np.maximum.accumulate(np.where(np.append(True, ~touch), i, 0))
                place = place[(i - begins) % 2 == 0]
        if not len(place):
            continue
        gone = after[place]
        end = after[gone]
        on = end >= 0
        beside = token[end[on]]
        token[place], token[gone], at[gone], at[place] = rank, -1, -1, -1
        after[place] = end
        before[end[on]] = place[on]
        both = token[end[on]] != beside  # what follows merges as well: before it does, it may make a lower rank
        if both.any():
            then = pairs.ranks(np.full(both.sum(), rank), beside[both])
            low = place[on][both][(then >= 0) & (then < rank)]
            odd.update((np.searchsorted(starts, low, "right") - 1).tolist())
        left = before[place]
        left = left[left >= 0]
        at[place[on]] = pairs.ranks(token[place[on]], token[end[on]])
        at[left] = pairs.ranks(token[left], token[after[left]])
        fresh = np.concatenate([place[on], left])
        low = fresh[(at[fresh] >= 0) & (at[fresh] < rank)]
        if len(low):
            odd.update((np.searchsorted(starts, low, "right") - 1).tolist())
        put(fresh)
    alive = np.flatnonzero(token >= 0)
    cuts = np.searchsorted(alive, starts)
    ids = token[alive].tolist()
    ends = np.append(cuts[1:], len(ids)).tolist()
    out = [ids[a:b] for a, b in zip(cuts.tolist(), ends, strict=True)]
    for k in odd:
        out[k] = merged(pieces[k], ranks, queue)
    return out


def newer_signs() -> str:
    """Letters and digits of the `regex` module's Unicode version that tiktoken's version doesn't have yet: there they are neither."""
    import regex
    import tiktoken

    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    signs, out = codes.tobytes().decode("utf-32-le"), ""
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("signs", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        known = set(bytes(library.encode_ordinary(signs)).decode())
        out += "".join(c for c in regex.findall(kind, signs) if c not in known)
    return out


class Coder:
    """Encodes and decodes by a file of ranks. Special strings are ordinary text."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: x for x, i in self.ranks.items()}
        self._pieces, self._queue, self._kept = regex.compile(pattern or public_tokenizers.PATTERN), RankQueue(max(self.ranks.values())), {}

    @cached_property
    def _pairs(self) -> Pairs:
        return Pairs(self.ranks)

    @cached_property
    def _newer(self) -> frozenset[str]:
        return frozenset(newer_signs())

    @cached_property
    def _plain(self) -> dict[int, str]:
        return dict.fromkeys(map(ord, self._newer), "\ue000")

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and not self._newer.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self._pieces.finditer(text.translate(self._plain))]
        return self._pieces.findall(text)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._split(x) for x in texts]
        wanted = set().union(*split)
        if len(self._kept) + len(wanted) > KEPT:
            self._kept.clear()
        kept, new = self._kept, []
        for m in wanted - kept.keys():
            whole = self.ranks.get(m.encode())
            if whole is None:
                new.append(m)
            else:
                kept[m] = [whole]
        if new:
            kept.update(zip(new, merged_all([m.encode() for m in new], self.ranks, self._pairs, self._queue), strict=True))
        out = [np.fromiter(chain.from_iterable(map(kept.__getitem__, pieces)), np.int32) for pieces in split]
        for m in new:
            if len(m) > KEPT_SIGNS:
                del kept[m]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id that the file lacks is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODERS: dict[tuple, Coder] = {}


def _coder(path: str | None, pattern: str | None) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _free(keep: list[str], name: str) -> None:
    if name in keep:
        raise ValueError(f"a kept column has the name of a result: {name}")


def encoded(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The kept columns (doc_id) and ids, an array of ints, for each row.

    A null text is empty and has no ids; repeated rows are encoded each; bytes that aren't UTF-8 count as U+FFFD. The file's path must be
    there on every executor, and every byte must have a rank. A kept column named `ids` is refused.
    """
    arrow_limits(docs.sparkSession)
    keep = keep if keep is not None else ["doc_id"]
    _free(keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            texts = texts_of(batch.column(len(keep)))
            for lo, hi in chunks(texts, TEXT_BYTES):
                own = coder.encode_all([x.decode("utf-8", "replace") for x in texts[lo:hi]])
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(keep))), ids], [*keep, "ids"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(x for x in (ddl(docs, keep), "ids array<int>") if x))


def decoded(rows: DataFrame, ids: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The kept columns (doc_id) and bytes, what the ids of each row stand for. Null ids are none; a null among them, or one that the file lacks, is an error."""
    arrow_limits(rows.sparkSession)
    keep = keep if keep is not None else ["doc_id"]
    _free(keep, "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, None)
        for batch in batches:
            out = pa.array([coder.decode(x.tolist()) if len(x) else b"" for x in _lists(batch.column(len(keep)))], pa.binary())
            yield with_columns(batch.rename_columns([*keep, "__ids"]), keep, {"bytes": out})

    return rows.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, ", ".join(x for x in (ddl(rows, keep), "bytes binary") if x))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row, one at a time."""
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids, comma-joined) and decoded_sha256 (of the decoded bytes) for each row."""
    rows = encoded(docs)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    rows = rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decoded(rows, keep=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
