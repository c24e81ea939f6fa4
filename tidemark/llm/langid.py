"""Language identification in two levels: the family first, then one-versus-one linear support vector machines within the family.

A text is the mean of the weights of its hashed letter n-grams, so every classifier is linear and a text of any length is one pass over its
bytes. The classifiers of both levels are fitted in numpy on a bounded sample of the labelled documents; all documents are scored in Spark.

A duel always has a winner. Whether a text is in the winner's language at all is told apart from the duels, by the mean log likelihood of its
n-grams in that language, against what texts with that label have.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, chunks, crc_mod, ddl, texts_of, with_columns

UNKNOWN = "und"
#: Families of languages by code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"),
    "uralic": ("fi", "et", "hu"),
}
DIMS = 4096
DRIFT, ENOUGH = 0.05, 20
#: Longer texts (bytes) are counted piece by piece.
LONG = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _letters() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


_TABLE = _letters()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-byte n-grams of the lower-cased letters of all texts, as one array, and where each text's begin (one more at the end).

    Every text stands between blanks, and whatever is no letter is one blank.
    """
    raw = np.frombuffer(b"".join(x + b"  " for x in texts), np.uint8)
    ends = np.cumsum([len(x) + 2 for x in texts])
    data = _TABLE[raw]
    c3 = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1 if len(raw) > 1 else np.zeros(0, np.int64)
    data[c3] += 0x20  # accented capitals
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[ends - 1] = keep[ends - 2] = True  # two blanks end each text: no n-gram but the last spans two texts
    data = data[keep].astype(np.uint32)
    stops = np.cumsum(keep)[ends - 1]
    two = data[:-2] | data[1:-1] << np.uint32(8)
    three = two | data[2:] << np.uint32(16)
    with np.errstate(over="ignore"):
        h = np.stack([two * np.uint32(2654435761), three * np.uint32(2246822519) + np.uint32(97)], 1) >> np.uint32(32 - 12)
    starts = np.minimum(np.concatenate([[0], stops]) * 2, h.size)
    return h.ravel().astype(np.int32), starts


def counts_of(text: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs in a text of any length, taken in pieces that end at a blank (or, for want of one, anywhere)."""
    out, lo = np.zeros(DIMS, np.int64), 0
    while lo < len(text):
        hi = len(text) if len(text) - lo <= LONG else text.rfind(b" ", lo + 1, lo + LONG) + 1 or lo + LONG
        out += np.bincount(grams([text[lo:hi]])[0], minlength=DIMS)
        lo = hi
    return out


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or _LETTER.search(text.decode("utf-8", "replace")) is not None


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; the last column of x is the bias."""
    rng, w, a, q = np.random.default_rng(7), np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            old = a[i]
            a[i] = min(max(old - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), c)
            if a[i] != old:
                w += (a[i] - old) * y[i] * x[i]
    return w


@dataclass
class Likelihood:
    """Of one language: log frequency of each n-gram, mean and variance of that over its n-grams, and the least standard value of a text."""

    logs: np.ndarray
    mean: float
    variance: float
    least: float = -np.inf

    def standard(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Texts' mean log frequencies as differences from the language's mean, by what n n-grams let expect and DRIFT between texts."""
        return (found - self.mean) / np.sqrt(self.variance / np.maximum(n, 1) + DRIFT**2)


def likelihoods(langs: list[str], x: np.ndarray, n: np.ndarray) -> dict[str, Likelihood]:
    """Frequencies from one half of each language's texts, and `least` from the other.

    Of its standard values, `least` is as far under the percentile as that is under the median, so the rare wrong labels don't set it. A
    language with under ENOUGH texts in that half takes the lowest `least` of those that have them.
    """
    half = np.array([crc32(row.astype(np.float32).tobytes()) & 1 for row in x], bool)
    out, sure = {}, []
    for code in sorted(set(langs)):
        own = np.array([y == code for y in langs])
        first, second = (own & half, own & ~half) if (own & half).any() and (own & ~half).any() else (own, own)
        p = x[first].mean(0, dtype=np.float64) + 1e-5
        logs = np.log(p / p.sum())
        mean = float(p @ logs / p.sum())
        out[code] = Likelihood(logs.astype(np.float32), mean, float(p @ logs**2 / p.sum()) - mean**2)
        low, mid = np.quantile(out[code].standard(x[second] @ logs, n[second]), [0.01, 0.5])
        out[code].least = float(2 * low - mid)
        sure += [code] * (int(second.sum()) >= ENOUGH)
    for code in set(out) - set(sure):
        out[code].least = min([out[code].least, *(out[k].least for k in sure)])
    return out


@dataclass
class Model:
    """Families of languages; weights has a column for each pair of families, then for each pair of languages of one family."""

    families: list[list[str]]
    duels: list[tuple[int, int, int]]  # family or -1 for the level of families, and the two contestants
    weights: np.ndarray
    bias: np.ndarray
    likely: dict[str, Likelihood] = field(default_factory=dict)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        if not len(self.duels):
            return out
        if any(len(x) > LONG for x in texts):  # counts times weights, in bounded memory
            for i, x in enumerate(texts):
                c = counts_of(x)
                out[i] += c @ self.weights / max(1, c.sum())
            return out
        h, starts = grams(texts)
        n = np.diff(starts)
        full = np.flatnonzero(n)
        if len(full):
            out[full] += np.add.reduceat(self.weights[h], starts[full], axis=0, dtype=np.float64) / n[full][:, None]
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Predicted language and a score of 0 to 1: the winners' mean probabilities against their rivals, multiplied over the levels."""
        p = 1 / (1 + np.exp(-2 * np.clip(self.margins(texts), -50, 50)))
        family, score = self._won(p, -1, len(self.families))
        lang = np.empty(len(texts), object)
        for f, names in enumerate(self.families):
            own = np.flatnonzero(family == f)
            best, s = self._won(p[own], f, len(names))
            lang[own], score[own] = np.array(names, object)[best], score[own] * s
        return lang.tolist(), score

    def familiar(self, texts: list[bytes], langs: list[str]) -> np.ndarray:
        """Whether each text's n-grams are as likely in its language as those of texts with that label."""
        out = np.ones(len(texts), bool)
        long = any(len(x) > LONG for x in texts)
        h, starts = (None, None) if long else grams(texts)
        for i, code in enumerate(langs):
            if code in self.likely:
                k = self.likely[code]
                if long:
                    c = counts_of(texts[i])
                    n, mean = int(c.sum()), float(c @ k.logs) / max(1, c.sum())
                else:
                    own = h[starts[i] : starts[i + 1]]
                    n, mean = len(own), k.logs[own].mean(dtype=np.float64) if len(own) else 0.0
                out[i] = n > 0 and k.standard(mean, n) >= k.least
        return out

    def _won(self, p: np.ndarray, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((len(p), n))
        for k, (f, a, b) in enumerate(self.duels):
            if f == level:
                sums[:, a] += p[:, k]
                sums[:, b] += 1 - p[:, k]
        if n == 1:
            return np.zeros(len(p), np.int64), np.ones(len(p))
        best = sums.argmax(1)
        return best, sums[np.arange(len(p)), best] / (n - 1)


def fit(langs: list[str], x: np.ndarray, families: dict[str, tuple[str, ...]] | None = None) -> Model:
    """x: a row of n-gram frequencies for each labelled text."""
    of = {code: name for name, codes in (families or FAMILIES).items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        groups.setdefault(of.get(code, code), []).append(code)
    levels = [groups[k] for k in sorted(groups)]
    scale = 1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-6)
    names, home = np.array(langs, object), np.array([next(f for f, g in enumerate(levels) if s in g) for s in langs], np.int64)
    duels, columns = [], []
    for level, labels, n in [(-1, home, len(levels)), *((f, names, len(g)) for f, g in enumerate(levels))]:
        for a, b in combinations(range(n), 2):
            first, second = (a, b) if level < 0 else (levels[level][a], levels[level][b])
            own = np.flatnonzero((labels == first) | (labels == second))
            duels.append((level, a, b))
            rows = np.ones((len(own), DIMS + 1))  # of one duel at a time: the driver holds no second copy of all
            np.multiply(x[own], scale, out=rows[:, :-1])
            columns.append(_svm(rows, np.where(labels[own] == first, 1.0, -1.0)))
    w = np.array(columns).reshape(-1, DIMS + 1)
    return Model(levels, duels, (w[:, :-1] * scale).T.astype(np.float32), w[:, -1].copy())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, per_lang: int = 400, reject: bool = False) -> Model:
    """Fits on about `per_lang` labelled texts of each language, taken by a hash of the row; rows with a null text or language teach nothing.

    With `reject` the model also learns which texts are in none of its languages. `per_lang` bounds the sample that the driver gets: a vector of DIMS frequencies for each text, at most 2 * per_lang for each language.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known if where is None else known.where(where)
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return Model([[UNKNOWN]], [], np.zeros((DIMS, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))))
    draw = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text")).limit(2 * per_lang * len(counts))

    def run(batches):
        for batch in batches:
            rows, sizes = [], []
            for x in texts_of(batch.column(1)):
                h, _ = grams([x])
                rows.append((np.bincount(h, minlength=DIMS) / max(1, len(h))).astype(np.float32).tobytes())
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(sizes, pa.int64())], ["lang", "x", "n"])

    rows = sample.mapInArrow(run, "lang string, x binary, n bigint").collect()
    if not rows:
        return Model([[sorted(counts)[0]]], [], np.zeros((DIMS, 0), np.float32), np.zeros(0))
    langs, sizes, x = [r.lang for r in rows], np.array([r.n for r in rows]), np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    del rows
    model = fit(langs, x)
    model.likely = likelihoods(langs, x, sizes) if reject else {}
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred and score of each row. A null text and one without a letter are `und` with score 0.

    If the model has learnt to reject, a text in none of its languages is `und` too.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    keep = keep if keep is not None else docs.columns
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("__text"))
            langs, scores, known = [], [], []
            for lo, hi in chunks(texts, 1 << 20):
                a, b = held.value.predict(texts[lo:hi])
                langs += a
                scores.append(b)
                known += held.value.familiar(texts[lo:hi], a).tolist() if held.value.likely else [True] * len(a)
            ok = [x and has_letter(y) for x, y in zip(known, texts, strict=True)]
            score = np.where(ok, np.concatenate(scores), 0.0) if scores else np.zeros(0)
            yield with_columns(batch, keep, {"lang_pred": pa.array([x if y else UNKNOWN for x, y in zip(langs, ok, strict=True)], pa.string()), "score": pa.array(score)})

    rows = docs.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, ", ".join(x for x in (ddl(docs, keep), "lang_pred string, score double") if x))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learnt from the rows that aren't held out."""
    model = train(docs.select("doc_id", "text", "lang"), where=crc_mod("doc_id", 5) != 0)
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text is in a learnt language.

    A text whose n-grams are unlikely in the language that won goes, and one without a letter; the score of the duels, which says which of the
    learnt languages is nearest, does not decide. Learnt from all rows with a language; where no row has one, every row with a letter stays.
    """
    model = train(docs, reject=True)
    found = identify(docs.withColumnsRenamed({x: f"__{i}" for i, x in enumerate(docs.columns)}), model, text=f"__{docs.columns.index('text')}")
    kept = found.where(F.col("lang_pred") != UNKNOWN if model.duels or model.likely else F.col("score") > 0)
    return kept.select(*(F.col(f"__{i}").alias(x) for i, x in enumerate(docs.columns)))
