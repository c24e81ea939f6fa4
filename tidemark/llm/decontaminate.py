"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of `words` consecutive benchmark words is one test string. A block shift table tells how far a text position can be moved
on; where the shift is zero, the bucket of the block's hash selects the test strings, and a direct comparison of bytes confirms an occurrence.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, cut, texts_of

#: Test strings are broadcast in blocks of about so many bytes of benchmark text; larger benchmarks take further passes.
BLOCK_CHARS = 16 << 20
_SEP, _END = 0x20, 0x0A
_JOIN = bytes([_SEP, _END, _SEP])


def _letters() -> np.ndarray:
    t = np.full(256, _SEP, np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[lo : hi + 1] = np.arange(lo, hi + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


_TABLE = _letters()


def normal(texts: list[bytes]) -> np.ndarray:
    """Lower-cased words with one blank around each; a line end stands before and after each text."""
    raw = np.frombuffer(b"".join([_JOIN, *(y for x in texts for y in (x, _JOIN))]), np.uint8)
    out = _TABLE[raw]
    at = np.cumsum([0, *(len(x) + 3 for x in texts)]) + 1
    out[at] = _END
    blank = out == _SEP
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return out[keep]


def words_of(text: bytes) -> list[bytes]:
    return normal([text]).tobytes().translate(None, bytes([_END])).split()


class _Searcher:
    """Wu-Manber tables of the test strings of one length class."""

    LANE = 512

    def __init__(self, strings: list[bytes], numbers: list[int]) -> None:
        self.m = min(map(len, strings))
        self.b = 8 if self.m >= 16 else max(2, self.m // 2)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        bits = min(22, max(12, int(len(strings) * (self.m - self.b + 1) * 8).bit_length()))
        self.drop = np.uint64(64 - bits)
        most = self.m - self.b + 1
        self.shift = np.full(1 << bits, most, np.int32)
        heads = np.array([list(s[: self.m] + bytes(8)) for s in strings], np.uint8)
        for j in range(most):  # later blocks leave smaller shifts
            h = self._hash(self._block(heads, j))
            self.shift[h] = np.minimum(self.shift[h], most - 1 - j)
        last = self._hash(self._block(heads, most - 1))
        order = np.argsort(last, kind="stable")
        self.bucket, self.strings, self.numbers = last[order], [strings[i] for i in order], [numbers[i] for i in order]
        self.prefix = (self._block(heads, 0))[order]

    def _block(self, rows: np.ndarray, j: int) -> np.ndarray:
        return np.ascontiguousarray(rows[:, j : j + 8]).view("<u8")[:, 0] & self.mask

    def _hash(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((block * np.uint64(0x9E3779B97F4A7C15)) >> self.drop).astype(np.int64)

    def find(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, number of the test string) of every occurrence."""
        n = len(data)
        if n < self.m:
            return
        blocks = np.ndarray((n,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        at = np.arange(self.m, n + 1, self.LANE)  # a cursor for each lane: the end of its window
        end = np.minimum(at + self.LANE, n + 1)
        found = []
        while len(at):
            s = self.shift[self._hash(blocks[at - self.b] & self.mask)]
            found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            on = at < end
            at, end = at[on], end[on]
        ends = np.concatenate(found)
        h = self._hash(blocks[ends - self.b] & self.mask)
        k, stop = np.searchsorted(self.bucket, h), np.searchsorted(self.bucket, h, "right")
        start = ends - self.m
        head = blocks[start] & self.mask
        whole = data.tobytes()
        while True:
            on = k < stop
            if not on.any():
                return
            k, stop, start, head = k[on], stop[on], start[on], head[on]
            for i in np.flatnonzero(self.prefix[k] == head):
                s = self.strings[k[i]]
                if whole.startswith(s, start[i]):
                    yield int(start[i]), self.numbers[k[i]]
            k = k + 1


class Patterns:
    """The windows of one block of benchmark items, and searchers for their length classes."""

    def __init__(self, items: list[tuple[int, bytes]], words: int) -> None:
        owners: dict[bytes, set[int]] = defaultdict(set)
        self.width: list[int] = []
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - words + 1) if w else 0):
                owners[b" " + b" ".join(w[i : i + words]) + b" "].add(item)
        strings = sorted(owners)
        self.items = [owners[s] for s in strings]
        self.width = [s.count(b" ") - 1 for s in strings]
        classes = defaultdict(list)
        for i, s in enumerate(strings):
            classes[min(5, len(s).bit_length())].append(i)
        self.searchers = [_Searcher([strings[i] for i in x], x) for x in classes.values()]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text its number of words, the merged [start, end) ranges of hit words and the items that occur."""
        data = normal(texts)
        first = np.flatnonzero(data == _END)[: len(texts) + 1]
        starts = np.zeros(len(data) + 1, np.int64)  # words that begin before a byte
        follows = (data[:-1] == _SEP) & (data[1:] != _SEP) & (data[1:] != _END)
        starts[1:-1] = np.cumsum(follows)
        starts[-1] = starts[-2]
        base = starts[first]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for s in self.searchers:
            for at, k in s.find(data):
                d = int(np.searchsorted(first, at, "right")) - 1
                w = int(starts[at] - base[d])
                hits[d].append((w, w + self.width[k]))
                items[d] |= self.items[k]
        out = []
        for d in range(len(texts)):
            ranges: list[tuple[int, int]] = []
            for lo, hi in sorted(hits.get(d, ())):
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(hi, ranges[-1][1]))
                else:
                    ranges.append((lo, hi))
            out.append((int(base[d + 1] - base[d]), ranges, sorted(items.get(d, ()))))
        return out


_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_ADDED = "n_words bigint, hit_ranges array<struct<lo:bigint,hi:bigint>>, items array<bigint>"


#: A worker builds the tables of a block once and keeps those of the last block it met.
_BUILT: dict[str, Patterns] = {}


def _built(key: str, held, words: int) -> Patterns:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(held.value, words)
    return _BUILT[key]


def _blocks(bench: DataFrame, words: int, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark (i, t) in blocks of about block_chars, one at a time on the driver. Long items are dealt in pieces that share words - 1 words."""

    def run(batches):
        most = max(4 * words, block_chars // 64)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                w = words_of(t)
                for lo in range(0, max(1, len(w) - words + 1), most):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([b" ".join(w[lo : lo + most + words - 1])], pa.binary())], ["i", "t"])

    pieces = bench.mapInArrow(run, "i bigint, t binary")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        yield [(r.i, bytes(r.t)) for r in (pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).toLocalIterator()]


def _scan_block(docs: DataFrame, text: str, items: list[tuple[int, bytes]], words: int) -> DataFrame:
    held, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        patterns = _built(key, held, words)
        for batch in batches:
            texts = texts_of(batch.column(text))
            found = [x for lo, hi in chunks(texts) for x in patterns.scan(texts[lo:hi])]
            added = [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([[{"lo": a, "hi": b} for a, b in x[1]] for x in found], _RANGES),
                pa.array([x[2] for x in found], pa.list_(pa.int64())),
            ]
            names = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *added], [*names, "n_words", "hit_ranges", "items"])

    rest = [f for f in docs.schema if f.name != text]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), _ADDED])
    return docs.mapInArrow(run, kinds)


def _merged(ranges: Column) -> Column:
    """How many words sorted, possibly overlapping ranges cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        F.array_sort(ranges), start, lambda a, r: F.struct(F.greatest(a["end"], r["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(a["end"], r["lo"]))).alias("n")), lambda a: a["n"]
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id_col, n_words, n_hit, hit_ranges and items of each row of docs.

    A null text has no words; an empty benchmark hits nothing; benchmark rows whose id or text is null are left out; repeated rows are each
    reported. The benchmark is read in blocks of bounded size, each searched over all documents; further columns are not carried.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    hashed = docs.withColumn("__text_hash", F.xxhash64("__text"))
    bench = benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    parts: list[DataFrame] = []
    for items in _blocks(bench, words, block_chars):  # with several, each search ends in a table before the next block is fetched
        if parts and len(parts) == 1:
            parts = [cut(parts[0], "block")]
        found = _scan_block(hashed, "__text", items, words)
        parts.append(cut(found.where(F.size("items") > 0), "block") if parts else found)
    blocks = len(parts)
    out = parts[0]
    if blocks > 1:  # what later blocks have found joins each row of the same id and text
        more = reduce(DataFrame.unionByName, parts[1:]).groupBy("__id", "__text_hash").agg(F.flatten(F.collect_set("hit_ranges")).alias("r"), F.flatten(F.collect_set("items")).alias("i"))
        both = out.join(cut(more, "blocks").withColumnsRenamed({"__id": "__i", "__text_hash": "__h"}), F.col("__id").eqNullSafe(F.col("__i")) & F.col("__text_hash").eqNullSafe(F.col("__h")), "left")
        all_ = lambda own, other: F.array_sort(F.array_distinct(F.concat(own, F.coalesce(other, F.array()))))
        out = both.select("__id", "n_words", all_("hit_ranges", "r").alias("hit_ranges"), all_("items", "i").alias("items"))
    return out.select(F.col("__id").alias(id_col), "n_words", _merged(F.col("hit_ranges")).cast("bigint").alias("n_hit"), "hit_ranges", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text holds no window of the benchmark.

    One pass over the documents for each block of the benchmark, no shuffle. A null text has no words and stays; repeated rows stay.
    """
    arrow_limits(docs.sparkSession)
    words, block_chars = options.get("words", 10), options.get("block_chars", BLOCK_CHARS)
    bench = benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    names = [f"__{k}" for k in range(len(docs.columns))]
    out = docs.toDF(*names)
    for k, items in enumerate(_blocks(bench, words, block_chars)):
        out = cut(out, "block") if k else out
        seen = _scan_block(out.select(*names, F.col(names[docs.columns.index("text")]).alias("__text")), "__text", items, words)
        out = seen.where(F.size("items") == 0).select(*names)
    return out.toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = occurrences(docs, benchmark, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
