"""Language-model scores: a log-bilinear model over words, trained with noise-contrastive estimation on all training texts.

Units of the model are the commonest words, and hash buckets that share out all other words. A unit's probability after two words is the
normalised exponential of the product of the predicted vector and the unit's vector, plus the unit's bias. A word beyond the commonest has the
probability of its bucket times its share of the bucket's counts, in which a word never seen has a share too; so the probabilities of all
words after a context add up to one.

The predicted vector depends on the context words' vectors: the commonest words have vectors of their own there, others share one with the
words that end alike. So there are CONTEXTS ** 2 contexts, whatever the size of the corpus, and the normalising sum of each, over all units, is
computed once by matrix products in tasks.

Training passes once over all training texts, in rounds: each task goes on from the parameters of the last round with the texts it holds, and
their results are averaged, each unit by how often a task has met it. Only averages reach the driver; their size is that of the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, crc_mod, cut, ddl, texts_of

#: At most so many of the commonest words are units of their own, each of at most so many bytes; the others share BUCKETS units.
HOT, HOT_BYTES, BUCKETS = 60_000, 64, 4_096
#: Context vectors: of the commonest words, of endings, and of lengths where the ending is rare.
SINGLE, ENDINGS, LENGTHS = 180, 68, 8
CONTEXTS = SINGLE + ENDINGS + LENGTHS
DIMS, ROUNDS = 16, 2
#: Tokens of one training task, about; there are never fewer tasks than cores.
TASK_TOKENS = 32_000_000
#: Words of one batch counted before they leave Python.
_COUNTED = 200_000
#: Counts fall into so many classes for each doubling, to find how many words are common.
_STEPS = 64
_SLICES = 128


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), b""]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, c): how often each token occurs in all texts. A null text is empty and has its end only."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        c: Counter[bytes] = Counter()
        for batch in batches:
            for x in texts_of(batch.column(0)):
                c.update(tokens_of(x))
                if len(c) > _COUNTED:
                    yield _pairs(c)
                    c = Counter()
        yield _pairs(c)

    return docs.select(text).mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def _pairs(c: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "c"])


@dataclass
class Units:
    """The words that are units, and what is known of the buckets of others. The size is bounded by HOT and BUCKETS."""

    hot: dict[bytes, int]
    count: np.ndarray  # of each unit
    context: np.ndarray  # of each hot word
    ending: dict[bytes, int]
    bucket_log: np.ndarray  # log10 of what a bucket's words share out
    start: int

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The unit of each word."""
        out = np.fromiter(map(self.hot.get, words, repeat(-1)), np.int32, len(words))
        cold = np.flatnonzero(out < 0)
        if len(cold):
            out[cold] = len(self.hot) + np.fromiter((crc32(words[i]) for i in cold.tolist()), np.int64, len(cold)) % BUCKETS
        return out

    def contexts(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The context vector of each word."""
        n = len(self.hot)
        out = self.context[np.minimum(ids, n)]
        for i in np.flatnonzero(ids >= n).tolist():
            out[i] = self.other_context(words[i])
        return out

    def other_context(self, word: bytes) -> int:
        return self.ending.get(word[-2:], SINGLE + ENDINGS + min(LENGTHS - 1, len(word) // 4))

    def pairs(self, contexts: np.ndarray) -> np.ndarray:
        """The number of the context (second last and last word) of each token of one text."""
        before = np.concatenate([[self.start, self.start], contexts[:-1]])
        return before[:-1] * CONTEXTS + before[1:]


def units(counts: DataFrame) -> Units:
    """Chooses the units by the counts of all words. The driver gets a histogram of the counts, then HOT words at most, and a row a bucket."""
    size = F.floor(F.log2("c") * _STEPS)
    short = counts.where(F.octet_length("token") <= HOT_BYTES)
    least, total = None, 0
    for r in sorted(short.groupBy(size.alias("s")).count().collect(), reverse=True):
        total += r["count"]
        if total > HOT:
            break
        least = r.s
    common = (F.octet_length("token") <= HOT_BYTES) & (size >= least) if least is not None else F.lit(False)
    rows = counts.where(common).limit(HOT).collect()
    words = sorted(((r.token.encode(), r.c) for r in rows), key=lambda x: (-x[1], x[0]))
    others = counts.where(~common).groupBy((F.crc32("token") % BUCKETS).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in others.collect():
        n[r.k], v[r.k] = r.n, r.v
    tails: Counter[bytes] = Counter()
    for w, c in words:
        if w:
            tails[w[-2:]] += c
    ending = {w: SINGLE + i for i, (w, _) in enumerate(sorted(tails.items(), key=lambda x: (-x[1], x[0]))[:ENDINGS])}
    hot = {w: i for i, (w, _) in enumerate(words)}
    out = Units(hot, np.concatenate([np.array([c for _, c in words], np.float64), n]), np.zeros(len(hot) + 1, np.int64), ending, np.log10(n + 0.1 * (v + 1)), 0)
    out.context[: len(hot)] = [i if i < SINGLE else out.other_context(w) for w, i in hot.items()]
    out.start = int(out.context[hot[b""]]) if b"" in hot else CONTEXTS - 1
    return out


@dataclass
class Bilinear:
    """Unit vectors and biases, context vectors, and the weights of both context positions."""

    t: np.ndarray
    b: np.ndarray
    r: np.ndarray
    c: np.ndarray

    def predicted(self, pairs: np.ndarray) -> np.ndarray:
        left, right = pairs // CONTEXTS, pairs % CONTEXTS
        return self.r[left] * self.c[0] + self.r[right] * self.c[1]

    def log_sums(self, left: int) -> np.ndarray:
        """Natural log of the normalising sum over all units, of the contexts with this second last word: batched matrix products."""
        q = self.predicted(left * CONTEXTS + np.arange(CONTEXTS))
        most, total = np.full(CONTEXTS, -np.inf), np.zeros(CONTEXTS)
        for lo in range(0, len(self.b), 4096):
            s = q @ self.t[lo : lo + 4096].T + self.b[lo : lo + 4096]
            new = np.maximum(most, s.max(1))
            total = total * np.exp(most - new) + np.exp(s - new[:, None].astype(np.float32)).sum(1, dtype=np.float64)
            most = new
        return most + np.log(total)


def initial(count: np.ndarray, seed: int = 5) -> Bilinear:
    """The model that gives the unigram probabilities after any context, but for small random vectors."""
    rng = np.random.default_rng(seed)
    p = (count + 0.5) / (count + 0.5).sum()
    t = np.zeros((len(count), DIMS), np.float32)
    return Bilinear(t, np.log(p).astype(np.float32), rng.normal(0, 0.5, (CONTEXTS, DIMS)).astype(np.float32), np.stack([np.full(DIMS, 0.5), np.ones(DIMS)]).astype(np.float32))


def _summed(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of `at`, the sums of their rows, and how many each has."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(rows[order], first, axis=0), np.diff(np.concatenate([first, [len(at)]]))


class Trainer:
    """Noise-contrastive estimation: the unit that came is told from units drawn from the unigrams, which all tokens of a batch share."""

    def __init__(self, model: Bilinear, count: np.ndarray, seed: int, noise: int = 64, batch: int = 1024, rate: float = 0.03) -> None:
        self.m = Bilinear(*(x.copy() for x in (model.t, model.b, model.r, model.c)))
        self.batch, self.noise, self.rate, self.rng = batch, noise, rate, np.random.default_rng(seed)
        p = (count + 0.5) / (count + 0.5).sum()
        self.log_noise, self.cumulative = (np.log(p) + np.log(noise)).astype(np.float32), np.cumsum(p)
        self.seen = np.zeros(len(count), np.float32)
        self.met = np.zeros(CONTEXTS, np.float32)
        self.sums = [np.full(len(count), 1.0, np.float32), np.full(CONTEXTS, 1.0, np.float32)]

    def add(self, pairs: np.ndarray, ids: np.ndarray) -> None:
        """One pass over these tokens, in random order."""
        order = self.rng.permutation(len(ids))
        for lo in range(0, len(ids), self.batch):
            at = order[lo : lo + self.batch]
            self._step(pairs[at], ids[at])

    def _move(self, x: np.ndarray, k: int, at: np.ndarray, g: np.ndarray) -> None:
        self.sums[k][at] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        x[at] -= (self.rate / np.sqrt(self.sums[k][at]))[:, None] * g

    def _step(self, pairs: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        left, right = (pairs // CONTEXTS).astype(np.uint8), (pairs % CONTEXTS).astype(np.uint8)
        rl, rr = m.r[left], m.r[right]
        q = rl * m.c[0] + rr * m.c[1]
        tw = m.t[w]
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), len(m.b) - 1)
        td = m.t[drawn]
        came = np.einsum("ij,ij->i", q, tw) + m.b[w] - self.log_noise[w]
        not_ = q @ td.T
        not_ += m.b[drawn] - self.log_noise[drawn]
        g_came = -1 / (1 + np.exp(np.minimum(came, 30)))  # of the loss by the score
        g_not = 1 / (1 + np.exp(np.minimum(-not_, 30)))
        dq = g_came[:, None] * tw + g_not @ td
        at, g, n = _summed(np.concatenate([g_came[:, None] * q, g_came[:, None]], 1), w.astype(np.uint16))
        self._unit(at, g, n)
        self._unit(drawn, np.concatenate([g_not.T @ q, g_not.sum(0)[:, None]], 1), np.ones(len(drawn)))
        for at_, k in ((left, 0), (right, 1)):
            place, g, n = _summed(dq, at_)
            self._move(m.r, 1, place, g * m.c[k])
            self.met[place] += n
        m.c -= 0.02 * np.clip(np.stack([(dq * rl).mean(0), (dq * rr).mean(0)]), -1, 1)

    def _unit(self, at: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        if len(at) > 1 and (np.diff(at) <= 0).any():  # the same unit may be drawn twice
            at, g, _ = _summed(g, at)
            n = 1.0
        self.sums[0][at] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        step = (self.rate / np.sqrt(self.sums[0][at]))[:, None] * g
        self.m.t[at] -= step[:, :-1]
        self.m.b[at] -= step[:, -1]
        self.seen[at] += n


def _rows_of(model: Bilinear, seen: np.ndarray, met: np.ndarray, tokens: float) -> Iterator[pa.RecordBatch]:
    """The parameters times their weights, and the weights, in slices of units; slice -1 has the context vectors and the position weights."""
    n = -(-len(model.b) // _SLICES)
    for k in range(0, _SLICES):
        lo, hi = k * n, min((k + 1) * n, len(model.b))
        if lo < hi and seen[lo:hi].any():
            w = seen[lo:hi, None].astype(np.float32)
            yield _row(k, np.concatenate([w, w * model.t[lo:hi], w * model.b[lo:hi, None]], 1))
    yield _row(-1, np.concatenate([met[:, None], met[:, None] * model.r], 1))
    yield _row(-2, np.concatenate([np.full((2, 1), tokens), tokens * model.c], 1))


def _row(k: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(x, np.float32).tobytes()], pa.binary())], ["slice", "x"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice: the sum of all that came."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("slice").to_pylist(), batch.column("x").to_pylist(), strict=True):
            y = np.frombuffer(x, np.float32).astype(np.float64)
            held[k] = held[k] + y if k in held else y
    for k, y in held.items():
        yield _row(k, y)


def averaged(rows: DataFrame, model: Bilinear) -> Bilinear:
    """The parameters averaged over all tasks; what no task has met stays as it was. Sums are made in tasks, twice, so no task gets a row of every task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "slice int, x binary"
    near = rows.withColumn("part", F.spark_partition_id() % 32).repartition(n, "slice", "part").select("slice", "x").mapInArrow(_added, kind)
    out = Bilinear(*(x.copy() for x in (model.t, model.b, model.r, model.c)))
    size = -(-len(model.b) // _SLICES)
    for r in near.repartition(n, "slice").mapInArrow(_added, kind).collect():
        x = np.frombuffer(r.x, np.float32).reshape(-1, DIMS + 2 if r.slice >= 0 else DIMS + 1)
        met = np.flatnonzero(x[:, 0] > 0)
        mean = x[met, 1:] / x[met, :1]
        if r.slice >= 0:
            out.t[r.slice * size + met], out.b[r.slice * size + met] = mean[:, :DIMS], mean[:, DIMS]
        elif r.slice == -1:
            out.r[met] = mean
        elif len(met):
            out.c[met] = mean
    return out


def train(docs: DataFrame, known: Units, text: str = "text", rounds: int = ROUNDS) -> Bilinear:
    """Fits the model on all texts; each text is in one round, by its hash."""
    spark = docs.sparkSession
    arrow_limits(spark)
    model, sc = initial(known.count), spark.sparkContext
    words = sc.broadcast(known)
    tasks = max(sc.defaultParallelism, int(known.count.sum() / rounds // TASK_TOKENS))
    for k in range(rounds):
        held = sc.broadcast(model)

        def run(batches, held=held, k=k):
            trainer, u, tokens = None, words.value, 0
            for batch in batches:
                pairs, ids = [], []
                for x in texts_of(batch.column(0)):
                    w = tokens_of(x)
                    own = u.ids(w)
                    ids.append(own)
                    pairs.append(u.pairs(u.contexts(w, own)))
                if ids:
                    trainer = trainer or Trainer(held.value, u.count, 11 + k)
                    trainer.add(np.concatenate(pairs), np.concatenate(ids))
                    tokens += sum(map(len, ids))
            if trainer:
                yield from _rows_of(trainer.m, trainer.seen, trainer.met, tokens)

        own = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(rounds)) == k)
        model = averaged(own.coalesce(tasks).mapInArrow(run, "slice int, x binary"), model)
        held.unpersist()
    return model


def log_sums(model: Bilinear, spark) -> np.ndarray:
    """The normalising sums (natural logs) of all contexts, computed in tasks; the driver gets CONTEXTS ** 2 numbers."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([held.value.log_sums(k).tobytes()], pa.binary())], ["left", "z"])

    rows = spark.range(0, CONTEXTS, 1, min(CONTEXTS, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "left bigint, z binary").collect()
    out = np.empty((CONTEXTS, CONTEXTS))
    for r in rows:
        out[r.left] = np.frombuffer(r.z)
    return out.ravel()


@dataclass
class Model:
    """What every worker holds; its size is fixed by HOT, BUCKETS and CONTEXTS."""

    units: Units
    bilinear: Bilinear
    sums: np.ndarray
    _predicted: np.ndarray | None = None

    def log10(self, pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of the probability of each unit after its context."""
        if self._predicted is None:
            self._predicted = self.bilinear.predicted(np.arange(CONTEXTS * CONTEXTS))
        s = np.einsum("ij,ij->i", self._predicted[pairs], self.bilinear.t[ids]) + self.bilinear.b[ids]
        return (s - self.sums[pairs]) / np.log(10)


def fitted(docs: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    known = units(counts)
    bilinear = train(docs, known, text)
    return Model(known, bilinear, log_sums(bilinear, docs.sparkSession))


def _partial(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """One row a text: what the units give, and its words beyond the commonest with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, u = held.value, held.value.units
        n = len(u.hot)
        log_count = np.log10(u.count[:n] + 0.1)
        for batch in batches:
            out = [[], [], [], [], [], []]
            for x in texts_of(batch.column("__text")):
                words = tokens_of(x)
                ids = u.ids(words)
                common = ids < n
                rare = np.flatnonzero(~common)
                part = m.log10(u.pairs(u.contexts(words, ids)), ids).sum() - u.bucket_log[ids[rare] - n].sum()
                cold = Counter(words[i] for i in rare.tolist())
                row = (len(words), int(common.sum()), float(log_count[ids[common]].sum()), float(part), list(cold), list(cold.values()))
                for a, b in zip(out, row, strict=True):
                    a.append(b)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [pa.array(a, k) for a, k in zip(out, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.list_(pa.string()))
            names = ["n_tokens", "n_hot", "hot_part", "model_part", "cold", "cold_n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), batch.column("__uid"), *arrays], [*keep, "__uid", *names])

    kinds = f"{ddl(docs, keep)}, __uid bigint, n_tokens bigint, n_hot bigint, hot_part double, model_part double, cold array<string>, cold_n array<bigint>"
    return docs.select(*keep, F.monotonically_increasing_id().alias("__uid"), F.col(text).alias("__text")).mapInArrow(run, kinds)


def score(docs: DataFrame, counts: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each whole text.

    Kept columns may have any names but those of the added ones. Words that are no units are looked up in the counts by a join on the word, once
    for each text that has them; none of them is common. A null text is empty and has its end only; repeated rows are each scored.
    """
    keep = keep if keep is not None else ["doc_id"]
    if taken := set(keep) & {"n_tokens", "n_known", "train_tokens", "base_score", "score", "n_hot", "hot_part", "model_part", "cold", "cold_n"}:
        raise ValueError(f"columns {sorted(taken)} can't be kept: the scores have these names")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    part = cut(_partial(docs, model, text, keep), "scores")
    pairs = part.select("__uid", F.explode(F.arrays_zip("cold", "cold_n")).alias("p")).select("__uid", F.col("p.cold").alias("token"), F.col("p.cold_n").alias("k"))
    found = pairs.join(counts, "token", "left").select("__uid", "k", (F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("part"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("seen"))
    sums = found.groupBy("__uid").agg(F.sum("part").alias("cold_part"), F.sum("seen").alias("cold_known"))
    both = part.drop("cold", "cold_n").join(sums, "__uid", "left")
    cold = F.coalesce("cold_part", F.lit(0.0))
    return both.select(
        *keep, "n_tokens", (F.col("n_hot") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("hot_part") + cold - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))).alias("base_score"), (cold + F.col("model_part")).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, learnt from all rows that aren't held out."""
    docs = docs.select("doc_id", "text")
    learn = docs.where(crc_mod("doc_id", 10) != 0)
    counts = cut(counted(learn), "counts")
    found = score(docs, counts, fitted(learn, counts))
    return found.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
