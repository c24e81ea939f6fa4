"""SimHash near-duplicates: fingerprints are compared per anchor of a covering code.

A 64-bit fingerprint has two halves of 31 bits (two bits are left to the final comparison). Of two fingerprints with at most 3 differing
bits, one half has at most 1. The anchors of a half are the words of the perfect Hamming(31, 26) code: its covering radius is 1, so every
half has exactly one nearest anchor, and a half one bit away lies within radius + threshold = 2 of that same anchor. Each fingerprint is
replicated to the anchors within 2 (16 at most) and is compared, per anchor, with the fingerprints whose nearest anchor it is.

The pipeline's stage (deduplicated) takes five words and a similarity of 0.8, which no few of 64 bits tell: its fingerprints are wider and have
72 blocks of 15 bits, whose anchors are the words of the perfect Hamming(15, 11) code. Texts with the nearest anchor of any block in common are compared by 128
further bits; what these leave is confirmed by the sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, cut, discard, mix, texts_of
from tidemark.llm.components import components

BITS, THRESHOLD, SEED = 31, 3, 42
_FULL = np.uint64((1 << BITS) - 1)
#: In groups above this size links that add nothing to a component are not looked for.
_PAIRWISE = 64


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of `width` words (fewer words: of all; none: nothing)."""
    words = text.lower().split()
    if not words:
        return []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    whole = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)]


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    hashes = [shingle_hashes(x, width) for x in texts]
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array([h for x in hashes for h in x], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, np.cumsum(sizes[full]) - sizes[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(set_ * 2 > sizes[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long. A null text counts as empty and has fingerprint 0."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            fp = np.concatenate([fingerprints_of(texts[lo:hi], width) for lo, hi in chunks(texts)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _syndrome_tables() -> np.ndarray:
    t = np.zeros((4, 256), np.uint64)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                at = 8 * byte + bit
                if value >> bit & 1 and at < BITS:
                    t[byte, value] ^= np.uint64(at + 1)
    return t


_TABLES = _syndrome_tables()
_ONE_BIT = np.array([0, *(1 << i for i in range(BITS))], np.uint64)  # by position + 1
#: For each syndrome the 15 pairs of positions whose flips lead to another code word.
_PAIRS = [np.array([_ONE_BIT[i] | _ONE_BIT[i ^ s] for i in range(1, BITS + 1) if i < i ^ s], np.uint64) for s in range(BITS + 1)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into half, anchor, whether it is the nearest) for every anchor within 2 of each 31-bit value."""
    s = np.zeros(len(half), np.uint64)
    for byte in range(4):
        s ^= _TABLES[byte, ((half >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
    at, near = [np.arange(len(half))], [np.ones(len(half), bool)]
    to = [half ^ _ONE_BIT[s.astype(np.int64)]]
    for value in range(1, BITS + 1):
        own = np.flatnonzero(s == value)
        pairs = _PAIRS[value]
        at.append(np.repeat(own, len(pairs)))
        to.append((half[own][:, None] ^ pairs[None, :]).ravel())
        near.append(np.zeros(len(own) * len(pairs), bool))
    return np.concatenate(at), np.concatenate(to), np.concatenate(near)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for part in np.array_split(fp, max(1, len(fp) // 2000)):
            for side, low in ((0, 0), (1, 64 - BITS)):
                at, to, near = anchors((part >> np.uint64(low)) & _FULL)
                key = (to | np.uint64(side << BITS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at].view(np.int64)), pa.array(near)], ["anchor", "fp", "near"])


def spanning_links(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the links of at most THRESHOLD differing bits connect: a search that leaves each fingerprint once."""
    rest = fp
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            linked = np.bitwise_count(rest ^ x) <= THRESHOLD
            if linked.any():
                new, rest = rest[linked], rest[~linked]
                todo.extend(new)
                yield np.full(len(new), x), new


def links_in_groups(anchor: np.ndarray, fp: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows that share an anchor; anchor is sorted."""
    if not len(anchor):
        return
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.concatenate([first, [len(anchor)]]))
    group = np.repeat(np.arange(len(first)), size)
    asks = np.flatnonzero(near & (size[group] > 1) & (size[group] <= _PAIRWISE))
    for some in np.array_split(asks, max(1, len(asks) // 100_000)):
        n = size[group[some]]
        other = np.repeat(first[group[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = np.repeat(fp[some], n), fp[other]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= THRESHOLD)
        yield x[ok], y[ok]
    for g in np.flatnonzero(size > _PAIRWISE):
        yield from spanning_links(np.unique(fp[first[g] : first[g] + size[g]]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns with all rows of each anchor, which comes first. Rows come sorted by anchor; what the last one of a batch has waits for the next batch."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        rows = tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if not len(rows[0]):
            continue
        if rows[0][0] == rows[0][-1]:
            if held and held[0][0][0] != rows[0][0]:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append(rows)
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held.append(tuple(x[:last] for x in rows))
        yield tuple(map(np.concatenate, zip(*held, strict=True)))
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches):
        for x, y in links_in_groups(rows[0], rows[1].view(np.uint64), rows[2]):
            if len(x):
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["x", "y"])


def links(distinct: DataFrame, partitions: int | None = None) -> DataFrame:
    """(x, y): enough links between the distinct fingerprints `fp` to connect all that lie within THRESHOLD bits of each other."""
    arrow_limits(distinct.sparkSession)
    spread = distinct.select("fp").mapInArrow(_replicated, "anchor bigint, fp bigint, near boolean")
    n = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    out = cut(spread.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_compared, "x bigint, y bigint").distinct(), "links")
    arrow_limits(distinct.sparkSession)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp, component_id): the smallest id that links of at most 3 differing bits reach.

    Equal fingerprints are one vertex, however many rows have it. A null text counts as empty; empty texts share fingerprint 0. Rows with a
    null id take their fingerprint's component; it is null if no row there has an id. Repeated rows are each reported. Further columns are
    not carried.
    """
    all_ = cut(fingerprints(docs, id_col, text, width), "fingerprints")
    vertices = cut(all_.groupBy("fp").agg(F.min(id_col).alias("least")), "vertices")
    pairs = links(vertices)
    low, high = vertices.select(F.col("fp").alias("x"), F.col("least").alias("u")), vertices.select(F.col("fp").alias("y"), F.col("least").alias("v"))
    found = components(pairs.join(low, "x").join(high, "y").select("u", "v"))
    named = vertices.join(found.withColumnRenamed("u", "least"), "least", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return all_.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of the stage, in words of 64 bits: WIDE bits are compared, and four blocks of BLOCK bits a word are brought to anchors. BLOCKS and FAR, the
#: most differing bits, are set for a similarity of 0.8, where 0.15 of the bits differ (0.17 of those of a few shingles).
WIDE, BLOCK, BLOCKS, FAR = 128, 15, 72, 37
_WORDS = WIDE // 64 + BLOCKS // 4
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, _WORDS, np.uint64)
#: For each byte its bits, one in each byte of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
#: Odd factors that order the values of a word anew for each byte, and their inverses.
_ORDER = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _ORDER], np.uint64)
#: In groups up to this size all pairs are compared at once.
_AT_ONCE = 1024
#: So many hubs, the nearest, are compared first with what hangs on them; a vertex has one a block at most.
_NEAREST = 8


def wide_fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """(text, word): a bit is 1 if set in over half the values of a text, none of which has no shingles (sorted). Of two equal halves that of one of the
    least shingles decides, another for each byte, so that an edit doesn't turn all ties at once."""
    sizes = np.array([len(x) for x in hashes])
    # some thousand shingles at a time stay in the cache
    ends = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // 8000, append=-1)) + 1
    return np.concatenate([_wide(hashes[a:b], sizes[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def _wide(hashes: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    all_, starts = np.concatenate(hashes), np.cumsum(sizes) - sizes
    # bytes hold sums of 255 rows at most
    pieces = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(starts, sizes, strict=True)])
    own = np.searchsorted(pieces, starts)
    few = np.minimum(sizes, 64)
    first = np.cumsum(few) - few
    head = np.arange(few.sum()) + np.repeat(starts - first, few)
    out = np.zeros((len(hashes), _WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_WORDS):
            values = mix(all_ ^ _SALTS[k])
            bytes_, some = values.view(np.uint8).reshape(-1, 8), values[head]
            sums = np.stack([np.add.reduceat(_LANES[bytes_[:, j]], pieces) for j in range(8)], 1).view(np.uint8)
            set_ = np.add.reduceat(sums, own, axis=0, dtype=np.int64)
            one = np.stack([(np.minimum.reduceat(some * _ORDER[j], first) * _BACK[j]).view(np.uint8).reshape(-1, 8)[:, j] for j in range(8)], 1)
            out[:, k] = np.packbits(2 * set_ + np.unpackbits(one, axis=1, bitorder="little") > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def four_shingles(x: np.ndarray) -> list[int]:
    """Hashes of the sets of four shingles in a set of four or five: where one is more than a fifth, more bits differ, and these sets are told exactly."""
    held = [x] if len(x) == 4 else [np.delete(x, i) for i in range(5)] if len(x) == 5 else []
    return [xxhash.xxh64_intdigest(y.tobytes(), SEED + 1) - (1 << 63) for y in held]


def block_anchors(fp: np.ndarray) -> np.ndarray:
    """(text, block): the number of the block and the anchor nearest to it."""
    blocks = np.stack([fp[:, WIDE // 64 + k // 4] >> np.uint64(BLOCK * (k % 4)) & np.uint64((1 << BLOCK) - 1) for k in range(BLOCKS)], 1)
    s = _TABLES[0, (blocks & np.uint64(255)).astype(np.int64)] ^ _TABLES[1, (blocks >> np.uint64(8)).astype(np.int64)]
    return (blocks ^ _ONE_BIT[s.astype(np.int64)]) | np.arange(BLOCKS, dtype=np.uint64) << np.uint64(BLOCK)


def clusters(n: np.ndarray, fp: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Indexes of the rows that are connected by links of at most FAR differing bits between sizes that allow the similarity, two at least."""
    fp = np.ascontiguousarray(fp.T)

    def linked(x, y):
        near = np.bitwise_count(fp[0][x] ^ fp[0][y]) + np.bitwise_count(fp[1][x] ^ fp[1][y]) <= FAR
        return near & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9)

    rest = np.arange(len(n))
    if len(n) <= _AT_ONCE:
        rest = np.flatnonzero(linked(rest[:, None], rest[None, :]).sum(1) > 1)
    while len(rest) > 1:
        todo, out, rest = [rest[0]], [rest[:1]], rest[1:]
        while todo and len(rest):
            ok = linked(todo.pop(), rest)
            if ok.any():
                out.append(rest[ok])
                todo.extend(rest[ok])
                rest = rest[~ok]
        if len(out) > 1:
            yield np.concatenate(out)


def bands_of(vertices: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(hub, __uid, n, m, far): what has a block's nearest anchor in common and is connected by near fingerprints hangs on its smallest row, the hub; the same
    row of one hub comes once, by however many anchors. n and m are the sizes of row and hub, far the differing bits.

    Of texts of similarity 0.8 no block has one nearest anchor, or over FAR bits differ, with a probability under 7e-5; of four and five shingles, more often,
    and these also meet by the sets of four they have. Beside the rows: the table that they read.
    """
    spark = vertices.sparkSession
    arrow_limits(spark)

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _WORDS)
            for lo in range(0, len(fp), 1000):
                part = fp[lo : lo + 1000]
                at = np.repeat(np.arange(lo, lo + len(part)), BLOCKS)
                wide = [pa.array(part[at - lo, k].view(np.int64)) for k in range(WIDE // 64)]
                yield pa.RecordBatch.from_arrays([pa.array(block_anchors(part).ravel().astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *wide], ["anchor", "__uid", "n", "f0", "f1"])

    def compared(batches):
        for anchor, uid, n, *wide in _whole(batches):
            fp = np.stack(wide, 1).view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            hubs, members = [], []
            for a, b in zip(first, [*first[1:], len(anchor)], strict=True):
                for at in clusters(n[a:b], fp[a:b], least):
                    at = a + at[np.argsort(uid[a:b][at])]
                    hubs.append(np.full(len(at) - 1, at[0]))
                    members.append(at[1:])
            if hubs:
                hub, own = np.concatenate(hubs), np.concatenate(members)
                far = np.bitwise_count(fp[hub] ^ fp[own]).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[hub], uid[own], n[own], n[hub], far)], ["hub", "__uid", "n", "m", "far"])

    rows = vertices.where("n > 0").select("__uid", "n", "fp").mapInArrow(spread, "anchor int, __uid bigint, n bigint, f0 bigint, f1 bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    out = cut(rows.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compared, "hub bigint, __uid bigint, n bigint, m bigint, far int").distinct(), "clusters")
    arrow_limits(spark)
    few = vertices.select(F.explode("few").alias("band"), "__uid", "n")
    least_ = few.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("__uid", "n")).alias("h")).where("k > 1").select("band", "h")
    few = few.join(least_, "band").where("__uid != h.__uid").select(F.col("h.__uid").alias("hub"), "__uid", "n", F.col("h.n").alias("m"), F.lit(0).alias("far"))
    return out.unionByName(few), out


def shingle_sets(rows: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(__uid, __id, th, key, n, fp, few, shingles): hashes of the text and of its set of shingles, the set's fingerprint and `four_shingles`, and the set itself (sorted, 32 bits each)."""
    arrow_limits(rows.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for lo, hi in chunks(texts, 2 << 20):
                hashes = [np.unique(np.array(shingle_hashes(x, width), np.uint64)) for x in texts[lo:hi]]
                full = [i for i, x in enumerate(hashes) if len(x)]
                fp = [[] for _ in hashes]
                if full:
                    for i, row in zip(full, wide_fingerprints([hashes[i] for i in full]).view(np.int64), strict=True):
                        fp[i] = row
                sets = [np.unique((x >> np.uint64(32)).astype("<u4")) for x in hashes]
                key = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in hashes], np.uint64).view(np.int64)
                th = np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts[lo:hi]], np.uint64).view(np.int64)
                few = [four_shingles(x) for x in sets]
                arrays = [th, key, np.array([len(x) for x in sets], np.int64), pa.array(fp, pa.list_(pa.int64())), pa.array(few, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())]
                arrays = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(x if isinstance(x, pa.Array) else pa.array(x) for x in arrays)]
                yield pa.RecordBatch.from_arrays(arrays, ["__uid", "__id", "th", "key", "n", "fp", "few", "shingles"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select("__uid", id_col, text).mapInArrow(run, f"__uid bigint, __id {kind}, th bigint, key bigint, n bigint, fp array<bigint>, few array<bigint>, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have a Jaccard similarity of `least` at least."""
    arrow_limits(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    first, second = (sets.select(F.col("__uid").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "uv")
    # Merged at every size: pairs are never sent to all tasks.
    return pairs.join(first.hint("merge"), "u").join(second.hint("merge"), "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u bigint, v bigint")


def rarest_shingles(vertices: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(token, __uid, n, left, typical) for the shingles by which a vertex of (__uid, n) can find similar ones.

    All sets are sorted by how many of the vertices have a shingle, the rarest first; left counts the shingles from this one on. Sets of
    similarity `least` have a shingle in common among those with left >= least * n. A vertex without any row is similar to none. typical is the
    mean number of vertices that have a shingle of the set.
    """
    arrow_limits(vertices.sparkSession)

    def run(batches):
        for batch in batches:
            held = [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
            for lo in range(0, len(held), 100):
                part = held[lo : lo + 100]
                at = pa.array(np.repeat(np.arange(lo, lo + len(part)), [len(x) for x in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(part).astype(np.int64))], ["__uid", "n", "token"])

    rows = sets.select("__uid", "shingles").join(vertices.hint("merge"), "__uid").select("__uid", "n", "shingles")
    tokens = cut(rows.mapInArrow(run, "__uid bigint, n bigint, token bigint"), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    one = Window.partitionBy("__uid")
    ranked = tokens.join(counts, "token").withColumn("left", F.col("n") + 1 - F.row_number().over(one.orderBy("df", "token"))).withColumn("typical", F.avg("df").over(one))
    ranked = cut(ranked.where((F.col("df") > 1) & (F.col("left") >= F.lit(least) * F.col("n") - 1e-9)).select("token", "__uid", "n", "left", "typical"), "ranked")
    discard(tokens)
    return ranked


#: Sizes of sets that differ by less than this share are in one bucket.
_STEP = 0.03


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log1p(_STEP)).cast("int")


def sharing(ranked: DataFrame, components_: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) with ends in different components (__uid, c) that can be similar, among them all that are.

    They have one of their rarest shingles in common, and what follows the first such one is long enough to hold all they have to share. For the
    smaller set of a pair that is nearly all of it, and for the larger it bounds the smaller's size from above; so each shingle of a set is
    looked up by sizes that fit, and copies that differ too much don't meet, however many there are and whatever they share further on. Of
    each shingle the component with most sets is left out on one side: its sets need no links among themselves.
    """
    t = F.lit(least)
    rows = cut(ranked.join(components_, "__uid"), "shared")
    sizes = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("parts"))
    kept = rows.join(sizes.where("parts > 1").select("token", "main"), "token").withColumn("other", F.col("c") != F.col("main"))
    room = F.floor(F.col("left") * (1 + t) / t - F.col("n") + 1e-6)
    larger = kept.withColumn("lo", F.ceil(t * F.col("n") - 1e-6)).withColumn("hi", F.least(F.col("n"), room)).where("lo <= hi and hi > 0")
    larger = larger.select("token", F.col("__uid").alias("u"), F.col("n").alias("n_u"), F.col("c").alias("c_u"), F.col("left").alias("l_u"), "other", F.explode(F.sequence(_bucket(F.greatest("lo", F.lit(1))), _bucket(F.col("hi")))).alias("bucket"))
    smaller = kept.where(F.col("left") * (1 + t) >= 2 * t * F.col("n") - 1e-6)
    smaller = smaller.select("token", F.col("__uid").alias("v"), F.col("n").alias("n_v"), F.col("c").alias("c_v"), F.col("left").alias("l_v"), F.col("other").alias("other_v"), _bucket(F.col("n")).alias("bucket"))
    fits = F.least("l_u", "l_v") * (1 + t) >= t * (F.col("n_u") + F.col("n_v")) - 1e-6
    once = (F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("v") > F.col("u")))

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        return one.join(two, ["token", "bucket"]).where((F.col("c_u") != F.col("c_v")) & fits & once & (F.col("n_v") >= t * F.col("n_u") - 1e-6)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    pairs = cut(met(larger.where("other"), smaller).unionByName(met(larger.where("not other"), smaller.where("other_v"))).distinct(), "pairs")
    discard(rows)
    return pairs


def similar(sets: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """(u, component): what links of similarity `least` connect; every vertex but the smallest of each component.

    What hangs on one hub (see `bands_of`) is a band, and its vertices are candidates. First each is compared with its nearest hubs; then, in bands that still
    lie in several components, with the most typical vertex of its band; then those of different components that `sharing` doesn't rule out are compared,
    which misses none of open bands. A vertex has a pair for each block at most in the steps before.
    """
    spread, kept = bands_of(vertices, least)
    bands = cut(spread, "bands")
    close = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("far", "hub"))), 1, _NEAREST)["hub"].alias("hubs")
    hubs = bands.where(close(F.col("n"), F.col("m"))).groupBy("__uid").agg(nearest)
    stars = cut(hubs.select(F.explode("hubs").alias("u"), F.col("__uid").alias("v")).distinct(), "stars")
    links_ = cut(confirmed(stars, sets, least), "links")
    held = lambda rows, found: rows.join(found.select(F.col("u").alias("__uid"), "component"), "__uid", "left").select(*rows.columns, F.coalesce("component", "__uid").alias("c"))
    found = components(links_)
    as_links = lambda found: found.select("u", F.col("component").alias("v"))
    ends = held(bands.select("__uid", "hub", "m"), found).select(F.col("hub").alias("__uid"), "m", F.col("c").alias("d"))
    mixed = cut(held(ends, found).where("c != d").groupBy(F.col("__uid").alias("hub")).agg(F.min("m").alias("n")), "mixed")
    rows = bands.join(mixed.select("hub"), "hub").select("hub", "__uid", "n").unionByName(mixed.select("hub", F.col("hub").alias("__uid"), "n"))
    open_ = cut(held(rows, found), "open")
    ranked = rarest_shingles(open_.select("__uid", "n").distinct(), sets, least)
    likely = open_.join(ranked.select("__uid", "typical").distinct(), "__uid")
    middle = likely.groupBy("hub").agg(F.max(F.struct("typical", "__uid", "n", "c")).alias("m"))
    spokes = likely.join(middle, "hub").where((F.col("c") != F.col("m.c")) & close(F.col("n"), F.col("m.n")))
    spokes = cut(spokes.select(F.least("__uid", "m.__uid").alias("u"), F.greatest("__uid", "m.__uid").alias("v")).distinct(), "spokes")
    found = components(as_links(found).unionByName(confirmed(spokes, sets, least)))
    rest = sharing(ranked, held(open_.select("__uid").distinct(), found), least)
    fresh = cut(rest.join(stars.unionByName(spokes), ["u", "v"], "left_anti"), "fresh")
    out = found if fresh.isEmpty() else components(as_links(found).unionByName(confirmed(fresh, sets, least)))
    discard(kept, bands, stars, mixed, open_, ranked, spokes, rest, fresh, links_)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: one row of each group stays, that of the smallest id.

    Texts are linked if their sets of runs of `width` words have a Jaccard similarity of `least` at least, by the sets themselves; texts with
    the same set are one vertex. Candidates are found by fingerprints and the anchors of a code. Of several rows with one id and text one stays. Rows without an id
    stay and link nothing.
    """
    rows = cut(docs.withColumn("__uid", F.monotonically_increasing_id()), "rows")
    sets = cut(shingle_sets(rows.where(F.col(id_col).isNotNull()), id_col, text, width), "sets")
    one = F.min(F.struct("__id", "th", "__uid", "n", "fp", "few")).alias("r")
    vertices = cut(sets.groupBy("key").agg(one).select("r.*"), "vertices")
    found = similar(sets, vertices, least).withColumnRenamed("u", "__uid")
    named = vertices.select("__uid", "__id", "th").join(found, "__uid", "left")
    keep = named.groupBy(F.coalesce("component", "__uid").alias("c")).agg(F.min(F.struct("__id", "th", "__uid")).alias("r")).select("r.__uid")
    keep = cut(keep, "keep")
    discard(sets, vertices)
    kept = rows.where(F.col(id_col).isNotNull()).join(keep, "__uid", "left_semi").select(*docs.columns)
    return kept.unionByName(rows.where(F.col(id_col).isNull()).select(*docs.columns))
