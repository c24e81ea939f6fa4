"""Packing of token sequences by non-negative least squares.

Each document is cut into whole windows and a remainder. Combinations of two or three remainders that fill a window exactly are enumerated;
non-negative least squares finds how often each is to be used, so that together they use up the histogram of remainder lengths over all
documents. The counts are rounded to what the histogram holds; what is left is packed greedily, cut where a window ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, cut, ddl, texts_of

WINDOW, END_ID = 2048, 1
#: Triples take their second length in steps of so many tokens.
TRIPLE_STEP = 16


def _encoder(path: str | None):
    """The tokenizer of a vocabulary file, run by tiktoken, which gives the same ids several times as fast; its special strings; and `tokenizers` itself."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    if max(spec["model"]["vocab"].values()) >= 1 << 16:
        raise ValueError("ids are held in 16 bits: a vocabulary of more than 65,536 entries can't be used")
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), special, Tokenizer.from_file(path)


_ENCODERS: dict[str | None, tuple] = {}


def encode(texts: list[str], path: str | None = None) -> list[np.ndarray]:
    """Ids of each text, with the end id. The file's special strings get their own ids, as `tokenizers` gives them."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _encoder(path)
    enc, special, slow = _ENCODERS[path]
    end = np.array([END_ID], np.uint32)

    def ids(x: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(x, allowed_special="all" if any(s in x for s in special) else set(), disallowed_special=())
        except ValueError:  # tiktoken's pattern matcher refuses very long runs of white space
            return np.array(slow.encode(x, add_special_tokens=False).ids, np.uint32)

    return [np.concatenate([ids(x), end]) for x in texts]


def tokenised(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """The kept columns, and for each row: part and seq (its place), n (tokens with the end id), r (n modulo the window), k and f (rows of this
    part before it with the same r; whole windows of this part before it), and ids as little-endian unsigned 16 bits."""
    arrow_limits(docs.sparkSession)
    keep = keep if keep is not None else ["doc_id"]
    if taken := {"part", "seq", "n", "r", "k", "f", "ids", "doc_tokens", "start", "length", "sequence_id", "offset", "pieces", "p"} & set(keep):
        raise ValueError(f"kept columns have names of results: {sorted(taken)}")

    def run(batches):
        part, seq, f, seen = TaskContext.get().partitionId(), 0, 0, np.zeros(window, np.int64)
        for batch in batches:
            texts = texts_of(batch.column("__text"))
            for lo, hi in chunks(texts):
                rows = []
                for ids in encode([x.decode("utf-8", "replace") for x in texts[lo:hi]], path):
                    n = len(ids)
                    r = n % window
                    rows.append((part, seq, n, r, int(seen[r]), f, ids.astype("<u2").tobytes()))
                    seen[r] += 1
                    seq, f = seq + 1, f + n // window
                some = batch.slice(lo, hi - lo)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*keep, "part", "seq", "n", "r", "k", "f", "ids"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{ddl(docs, keep)}, part int, seq bigint, n bigint, r int, k bigint, f bigint, ids binary")


def combinations(window: int = WINDOW, step: int = TRIPLE_STEP) -> np.ndarray:
    """Rows of three ascending lengths (the first 0 for pairs) that add up to the window."""
    a = np.arange(1, window // 2 + 1)
    rows = [np.stack([np.zeros_like(a), a, window - a], 1)]
    for x in range(1, window // 3 + 1):
        y = np.arange(x, (window - x) // 2 + 1, step)
        rows.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    return np.concatenate(rows)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often each combination is used: non-negative least squares by accelerated projected gradients, then rounded to what is there."""
    h = histogram.astype(np.float64)
    h[0] = 0
    flat, width = combos.ravel(), combos.shape[1]
    use = np.bincount(flat, minlength=len(h)).astype(np.float64)
    weight = 1 / np.sqrt(np.maximum(h, 1.0))  # lengths count by their relative error

    def times(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, width), len(h))
        out[0] = 0
        return out

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[combos].sum(1)

    step = 1 / max(1e-9, width * (use[1:] * weight[1:] ** 2).max())
    x = z = np.zeros(len(combos))
    for k in range(rounds):
        new = np.maximum(z - step * back(weight**2 * (times(z) - h)), 0)
        z, x = new + k / (k + 3) * (new - x), new
    left, out = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for wanted in (np.floor(x), np.ceil(x), np.full(len(x), np.inf)):  # what rounding down leaves is used again, the most wanted first
        for j in np.argsort(-x, kind="stable"):
            if wanted[j] > out[j]:
                lengths, times_ = np.unique(combos[j][combos[j] > 0], return_counts=True)
                n = int(min(wanted[j] - out[j], (left[lengths] // times_).min()))
                if n > 0:
                    out[j] += n
                    left[lengths] -= n * times_
    return out


def plan(histogram: np.ndarray, combos: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(r, lo, hi, copies, first sequence, offset): the rows of length r with ranks lo to hi - 1 go, `copies` to a sequence, to the sequences
    from the first on, at this offset."""
    counts, used, sequence, out = repeats(histogram, combos), np.zeros(len(histogram), np.int64), 0, []
    for j in np.flatnonzero(counts):
        offset, n = 0, int(counts[j])
        lengths, copies = np.unique(combos[j][combos[j] > 0], return_counts=True)
        for r, m in zip(lengths.tolist(), copies.tolist(), strict=True):
            out.append((r, int(used[r]), int(used[r]) + n * m, m, sequence, offset))
            used[r] += n * m
            offset += r * m
        sequence += n
    return out


def _running(df: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """What all parts before a part add up to, for each key. A part has one row, however many documents it holds."""
    totals = df.groupBy(*key, "part").agg(value.alias("__total"))
    w = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*key, "part", F.coalesce(F.sum("__total").over(w), F.lit(0)).alias(name))


def pieces(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """The kept columns and start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id and offset of each piece.

    A null text is empty and has the end id only; repeated rows are packed each; no document gives no piece. All sequences but at most one
    are full windows. Kept columns with names of results are refused.
    """
    spark = docs.sparkSession
    keep = keep if keep is not None else ["doc_id"]
    rows = cut(tokenised(docs, text, keep, window, path), "tokens")
    histogram = np.zeros(window, np.int64)
    for r in rows.groupBy("r").count().collect():
        histogram[r["r"]] = r["count"]
    slots = spark.createDataFrame(plan(histogram, combinations(window)), "slot_r int, lo bigint, hi bigint, copies bigint, first bigint, at bigint")
    narrow = rows.select("part", "seq", "n", "r", "k", "f")
    ranked = narrow.join(_running(narrow, ["r"], F.count(F.lit(1)), "before"), ["r", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    whole = _running(narrow.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("w")), [], F.sum("w"), "whole_before")
    # A row has one slot at most; a length has at most as many slots as there are combinations with it, whatever the number of documents.
    slot = F.broadcast(slots)
    placed = ranked.join(slot, (F.col("r") == F.col("slot_r")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    i = F.col("rank") - F.col("lo")
    placed = placed.select("part", "seq", "n", "r", "f", (F.col("first") + F.floor(i / F.col("copies"))).alias("combined"), (F.col("at") + i % F.col("copies") * F.col("r")).alias("at"))
    placed = cut(placed.join(whole, "part"), "slots")
    rest = placed.where((F.col("r") > 0) & F.col("combined").isNull()).select("part", "seq", "r")
    flow = rest.withColumn("local", F.sum("r").over(Window.partitionBy("part").orderBy("seq")) - F.col("r"))
    flow = flow.join(_running(rest, [], F.sum("r"), "rest_before"), "part").select("part", "seq", (F.col("local") + F.col("rest_before")).alias("flow"))
    placed = placed.join(flow, ["part", "seq"], "left")
    # Sequence numbers: 3 i for whole windows, 3 i + 1 for combinations, 3 i + 2 for what is packed greedily.
    full, r, flow_at = F.floor(F.col("n") / window), F.col("r").cast("bigint"), F.col("flow")
    first = F.least(r, window - flow_at % window)

    def piece(start, length, sequence, offset):
        return F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"), sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))

    windows = F.when(full > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), full - 1), lambda j: piece(j * window, F.lit(window), (F.col("whole_before") + F.col("f") + j) * 3, F.lit(0))))
    combined = F.when(F.col("combined").isNotNull(), F.array(piece(full * window, r, F.col("combined") * 3 + 1, F.col("at"))))
    greedy = F.when(flow_at.isNotNull(), F.array(piece(full * window, first, F.floor(flow_at / window) * 3 + 2, flow_at % window), piece(full * window + first, r - first, (F.floor(flow_at / window) + 1) * 3 + 2, F.lit(0))))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    all_ = F.filter(F.concat(*(F.coalesce(x, none) for x in (windows, combined, greedy))), lambda p: p["length"] > 0)
    spec = placed.select("part", "seq", all_.alias("pieces"))
    both = rows.select(*keep, "part", "seq", "n", "ids").join(spec.hint("merge"), ["part", "seq"])
    out = both.select(*keep, F.col("n").alias("doc_tokens"), "ids", F.explode("pieces").alias("p")).select(*keep, "doc_tokens", "p.*", F.expr("substring(ids, cast(p.start * 2 + 1 as int), cast(p.length * 2 as int))").alias("ids"))

    def widen(batches):
        for batch in batches:
            ids = pa.array([np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)

    return out.mapInArrow(widen, out.schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    return pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
