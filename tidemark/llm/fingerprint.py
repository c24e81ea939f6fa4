"""Document fingerprints: a homomorphic multiset hash. DataFrame expressions only.

Every paragraph (line) of a text is hashed to a wide vector; a text's vector is the sum of its paragraphs' vectors, each lane modulo a power
of two. Equal multisets of paragraphs have equal vectors in any order, and a paragraph is inserted or deleted by adding or subtracting its
vector. A vector has EXACT lanes from the hash of the whole paragraph (modulo 2**32), then the number of word triples of the paragraph,
then lanes that count the bits of the hashes of its word triples, two lanes of 31 and 32 bits in a long. The latter are a sketch: the angle
between two of them tells how much the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LONGS, HASHES = 8, 31, 2
LANES = EXACT + 1 + LONGS * HASHES
_MASK, _HALF = (1 << 31) | 1, (1 << 31) - 1
_WRAP = 1 << 32


def _rows(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """A row for each word of each paragraph: the keys, the place of the word, two hashes of the paragraph and the hash of three words."""
    paragraphs = df.select(*keys, F.explode(F.split(text, "\n")).alias("__p"))
    words = paragraphs.select(*keys, F.xxhash64("__p").alias("__a"), F.xxhash64(F.lit(1), "__p").alias("__b"), F.split("__p", "\x20").alias("__w"))
    n = F.size("__w")
    triples = F.arrays_zip("__w", F.slice("__w", F.lit(2), n), F.slice("__w", F.lit(3), n))
    out = words.select(*keys, "__a", "__b", F.posexplode(triples).alias("__i", "__s"))
    one = F.xxhash64(F.col("__s.__w"), F.col("__s.1"), F.col("__s.2"))
    return out.select(*keys, "__i", "__a", "__b", one.alias("__h"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and v, the vector."""
    rows = rows.withColumn("__g", F.xxhash64("__h", F.lit(7)))
    exact = [F.sum(F.when(F.col("__i") == 0, F.xxhash64("__a", "__b", F.lit(k)).bitwiseAND(_WRAP - 1))).alias(f"__e{k}") for k in range(EXACT)]
    bits = [F.sum(F.shiftright(h, j).bitwiseAND(_MASK)).alias(f"__s{k}_{j}") for k, h in enumerate(("__h", "__g")[:HASHES]) for j in range(LONGS)]
    out = rows.groupBy(*keys).agg(*exact, F.count(F.lit(1)).alias("__n"), *bits)
    lanes = [F.pmod(F.col(f"__e{k}"), F.lit(_WRAP)) for k in range(EXACT)] + [F.col("__n")] + [F.col(f"__s{k}_{j}") for k in range(HASHES) for j in range(LONGS)]
    return out.select(*keys, F.array(*lanes).alias("v"))


def vectors(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and v, the vector of all texts with these keys (of one paragraph or many). A null text counts as one empty paragraph."""
    return _sums(_rows(df, keys, F.coalesce(F.col(text), F.lit(""))), keys)


def added(v: Column, w: Column) -> Column:
    """The vector of what v and w have together: insertion."""
    return F.zip_with(v, F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a, b: F.when(b["i"] < EXACT, F.pmod(a + b["x"], F.lit(_WRAP))).otherwise(a + b["x"]))


def removed(v: Column, w: Column) -> Column:
    """The vector of v without w, which is part of it: deletion."""
    return F.zip_with(v, F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a, b: F.when(b["i"] < EXACT, F.pmod(a - b["x"], F.lit(_WRAP))).otherwise(a - b["x"]))


def hexed(v: Column) -> Column:
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(x), F.when(i < EXACT, 8).otherwise(16), F.lit("0"))), ""))


def signed(v: Column) -> Column:
    """The sketch as sums of +1 and -1: twice the count of a bit less the number of word triples."""
    n = F.get(v, F.lit(EXACT))
    packed = F.slice(v, EXACT + 2, LONGS * HASHES)
    low = F.transform(packed, lambda x: (x.bitwiseAND(_HALF) * 2 - n).cast("double"))
    return F.concat(low, F.transform(packed, lambda x: (F.shiftright(x, 31) * 2 - n).cast("double")))


def likeness(v: Column, w: Column, sv: Column, sw: Column) -> Column:
    """1 for equal vectors, else the cosine of the sketches, from 0; sv and sw are the signed forms of v and w."""

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(sv, sv) * dot(sw, sw))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sv, sw) / norm))).otherwise(F.lit(0.0))
    return F.when(v == w, F.lit(1.0)).otherwise(cosine)


def with_next(docs: DataFrame, id_col: str, text: str, partitions: int) -> DataFrame:
    """Adds bucket, rn (place in the bucket), ghost and next (the next text by ascending id; after the last comes the first).

    Rows go to buckets of id ranges, one shuffle in all. A bucket's first row also goes, as a ghost, to the end of the bucket before.
    Rows with a null id come first; rows of one id are in the order of their texts' hashes. There are four buckets to a partition, so that
    partitions get about as many rows each.
    """
    buckets = 4 * partitions
    k = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    low, cuts = docs.agg(F.min(k), F.percentile_approx(k, [i / buckets for i in range(1, buckets)], 10_000)).first()
    bounds = sorted({low, *(cuts or [])} - {None})
    held = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    df = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"), k.alias("__k"))
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(max(1, len(bounds)).bit_length()))))
    # binary search: how many bounds are at most the id
    below = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(held, n + s - 1) <= F.col("__k"), F.lit(False)), n + s).otherwise(n))
    df = df.withColumn("bucket", below - 1)
    home = F.struct("bucket", F.lit(False).alias("ghost"), F.lit(False).alias("wrap"))
    before = F.struct(F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(len(bounds) - 1).alias("bucket"), F.lit(True).alias("ghost"), (F.col("bucket") == 0).alias("wrap"))
    places = F.when(F.get(held, F.col("bucket")) == F.col("__k"), F.array(home, before)).otherwise(F.array(home))
    dealt = df.select(id_col, "text", "__k", F.explode(places).alias("__x")).select(id_col, "text", "__k", F.xxhash64("text").alias("__h"), "__x.*")
    w = Window.partitionBy("bucket").orderBy("wrap", "__k", "ghost", "__h")
    return dealt.repartition(partitions, "bucket").select(id_col, "text", "bucket", "ghost", F.lead("text").over(w).alias("next"), F.row_number().over(w).alias("rn"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    Texts are read and shuffled once, by ranges of ids; all later steps keep that partitioning.
    """
    spark = docs.sparkSession
    rows = with_next(docs.select("doc_id", "text"), "doc_id", "text", int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("ghost"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("bucket", "rn", "ghost", "doc_id", n.cast("bigint").alias("n"), "text", edited.alias("edited"))
    meta = F.struct("doc_id", "n", "ghost", F.sha2("edited", 256).alias("sha"))
    forms = F.array(*(F.struct(F.lit(k).alias("form"), t.alias("t"), F.when(F.lit(k == 2), meta).alias("meta")) for k, t in enumerate((F.col("text"), F.col("edited"), F.lit("")))))
    each = rows.select("bucket", "rn", F.explode(forms).alias("__f")).select("bucket", "rn", "__f.form", "__f.t", "__f.meta").where("t is not null")
    keys = ["bucket", "rn", "form", "meta"]  # meta is a key so that all aggregates are sums, which need no sort
    sums = _sums(_rows(each, keys, F.col("t")), keys)
    of = {form: F.max(F.when(F.col("form") == form, F.col(column))) for form, column in ((0, "v"), (1, "v"))}
    # max() of a struct with nulls would compare its fields, so the only row that has one is taken by first()
    both = sums.groupBy("bucket", "rn").agg(of[0].alias("v"), of[1].alias("e"), F.first(F.when(F.col("form") == 2, F.col("meta")), ignorenulls=True).alias("meta"))
    both = both.select("*", signed(F.col("v")).alias("sv"), signed(F.col("e")).alias("se"))
    w = Window.partitionBy("bucket").orderBy("rn")
    both = both.select("*", F.lead("v").over(w).alias("x"), F.lead("sv").over(w).alias("sx")).where(~F.col("meta.ghost"))
    c = F.col
    return both.select(
        "meta.doc_id", c("meta.n").alias("n_chars"), c("meta.sha").alias("edited_sha256"), hexed(c("v")).alias("fingerprint"), hexed(c("e")).alias("edited_fingerprint"),
        likeness(c("v"), c("e"), c("sv"), c("se")).alias("near_edited"), likeness(c("v"), c("x"), c("sv"), c("sx")).alias("near_next"),
    )
