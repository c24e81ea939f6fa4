"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; the logistic loss of feature differences over pairs of a preferred and a
rejected document is minimised. Strengths are cut at a quantile of the training strengths and mapped so that the cut has score 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, crc_mod, cut, ddl, texts_of, with_columns

NAMES = ("log_words", "word_length", "long_words", "one_letter", "capitals", "marks", "symbols", "digits", "repeated_lines", "distinct_words", "repeated_next", "line_words", "ends")
CUT_SCORE = 0.7
_KNOTS = 6


def _classes() -> np.ndarray:
    """Per byte: letter, capital, sentence mark, other symbol, digit."""
    t = np.zeros((256, 5), np.float32)
    t[0x61:0x7B, 0] = t[0x41:0x5B, 0] = t[0xC3:, 0] = 1
    t[0x41:0x5B, 1] = 1
    t[[ord(c) for c in ".,;:!?"], 2] = 1
    t[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'-"], 3] = 1
    t[0x30:0x3A, 4] = 1
    return t


_CLASSES = _classes()


def features(text: bytes, counts: np.ndarray) -> list[float]:
    words = text.split()
    n, lines = max(1, len(words)), [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    letters = max(1.0, counts[0])
    return [
        float(np.log1p(len(words))), float(sizes.mean()), float((sizes > 14).mean()), float((sizes == 1).mean()), counts[1] / letters, counts[2] / n, counts[3] / n, counts[4] / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(len(set(words))) / np.log1p(n)), sum(map(bytes.__eq__, words, words[1:])) / n, float(np.log1p(n / max(1, len(lines)))),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros((0, len(NAMES)))
    data = np.frombuffer(b"".join(x + b"\n" for x in texts), np.uint8)
    starts = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    counts = np.add.reduceat(_CLASSES[data], starts, axis=0, dtype=np.float64)
    accented = np.concatenate([[False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)])
    counts[:, 1] += np.add.reduceat(accented.astype(np.float64), starts)
    return np.array([features(x, c) for x, c in zip(texts, counts, strict=True)])


def described(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs and x, the features of each whole text. A null text counts as empty."""
    arrow_limits(docs.sparkSession)
    keep = keep if keep is not None else [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("__text"))
            x = np.concatenate([matrix(texts[lo:hi]) for lo, hi in chunks(texts, 2 << 20)] or [np.zeros((0, len(NAMES)))])
            yield with_columns(batch, keep, {"x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(y for y in (ddl(docs, keep), "x array<double>") if y))


@dataclass
class Model:
    """Strength: bias + sum over features of weight times hinge; score: the logistic curve that gives CUT_SCORE at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in self.knots)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.slope * (self.expand(x) @ self.weights - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = 40_000, rounds: int = 400, quantile: float | None = None) -> Model:
    """Learns from `pairs` random pairs of a document with label 1 and one with label 0.

    quantile: the share of training documents below the cut; None takes the one with the best mean of both labels' accuracies.
    """
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
    model = Model(mean, scale, np.quantile(np.clip((x - mean) / scale, -8, 8), np.linspace(0.02, 0.98, _KNOTS), axis=0) if len(x) else np.zeros((_KNOTS, width)), np.zeros(width * (_KNOTS + 1)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    rng, z = np.random.default_rng(11), model.expand(x)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    step, w = 4.0 / max(1e-9, np.linalg.norm(d, 2) ** 2 / len(d)), np.zeros(d.shape[1])
    momentum = w
    for k in range(rounds):  # accelerated gradient of the mean logistic loss with a small ridge
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ momentum, -40, 40))))) / len(d) + 1e-4 * momentum
        new = momentum - step * g
        momentum, w = new + k / (k + 3) * (new - w), new
    model.weights = w
    s = z @ w
    if quantile is None:
        qs = np.linspace(0.005, 0.9, 180)
        cuts = np.quantile(s, qs)
        gain = [(s[good] >= c).mean() + (s[bad] < c).mean() for c in cuts]
        best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
        quantile = float(qs[best[len(best) // 2]])
    model.cut = float(np.quantile(s, quantile))
    model.slope = float(np.clip(4 / (np.quantile(s, 0.9) - np.quantile(s, 0.1) + 1e-9), 0.05, 20))
    return model


def train(described_docs: DataFrame, labels: DataFrame, where: Column | None = None, most: int = 6000) -> Model:
    """Fits on labelled rows, at most about `most` (the documented bound of what the driver gets), taken by a hash of the id.

    A document with several labels counts by their mean; rows with a null id or label teach nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, min(1.0, most / 2 / max(1, counts.get(1, 0)))).otherwise(min(1.0, most / 2 / max(1, counts.get(0, 0))))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share).limit(2 * most)
    rows = described_docs.select("doc_id", "x").join(sample, "doc_id").limit(4 * most).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.quality for r in rows]))


def scored(described_docs: DataFrame, model: Model) -> DataFrame:
    """All columns of described_docs but x, and score."""
    held = described_docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in described_docs.columns if c != "x"]

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield with_columns(batch, keep, {"score": pa.array(held.value.score(x))})

    return described_docs.select(*keep, "x").mapInArrow(run, ", ".join(y for y in (ddl(described_docs, keep), "score double") if y))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; learnt from the rows that aren't held out. The features are computed once and kept as a table."""
    x = cut(described(docs.select("doc_id", "text")), "features")
    found = scored(x, train(x, labels, where=crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
