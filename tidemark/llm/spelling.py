"""Spelling variants: words one edit apart, found by automata over halves of words.

A single edit leaves a part of a word whole: what comes before it and what follows. A word's entries say where the edit may lie (lo to hi);
its signs before and after are its segments. At first lo to hi is either half, so the whole segments are the other half. Words that share
segments and lengths meet under one key. Keys with too many pairs are halved again, which makes the segments longer, until they are few or
the place of the edit is known to a sign, where the alphabet bounds the pairs. So no group is too large for a task, and none is cut.

Keys are dealt to shards. A shard's automaton (Aho-Corasick) holds the segments of the words that own entries there; all words that have come
to the shard are scanned, a hit must be at the segment's place in a word of a fitting length, and the distance is verified on whole words.

All joins are merge joins: Spark sizes a table by its compressed files, and what is exploded from it no larger, so it would broadcast through the
driver what has many times that size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with more pairs than this is halved again. A shard has about so many entries, or so many signs in them.
MOST_PAIRS, SHARD_ENTRIES, SHARD_SIGNS = 20_000, 50_000, 8_000_000


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_signs: int = 5, least_times: int = 3, typo_every: int = 97) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with their occurrences in all texts.

    Where the crc32 of `<doc_id>:<run>` is divisible by typo_every, the run loses a sign (0: none does). A null text has no words; a null id
    counts as empty; repeated rows count each.
    """
    # A shorter run can't become a word; it goes before anything is computed for it.
    rows = docs.select(F.col(doc_id).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= least_signs)
    word = F.translate("run", _UPPER, _UPPER.lower())
    if typo_every:
        rows = rows.select(word.alias("run"), "d").withColumn("h", F.crc32(F.concat(F.coalesce(F.col("d").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
        word = F.when(F.col("h") % typo_every == 0, F.expr("concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2))")).otherwise(F.col("run"))
    rows = rows.select(word.alias("word")).where(F.char_length("word") >= least_signs)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def _key() -> Column:
    """Of an entry: equal for all words that may be one edit from each other within lo to hi of a word of `size` signs."""
    before, after = F.expr("substring(word, 1, lo)"), F.expr("substring(word, char_length(word) - (size - hi) + 1)")
    return F.xxhash64("size", "lo", "hi", before, F.when(F.col("hi") < F.col("size"), after).otherwise(F.lit("")))


def _halved(rows: DataFrame) -> DataFrame:
    """Each entry's two halves. A part without signs is dropped: no edit can lie there."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    parts = F.filter(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))), lambda p: p["hi"] > p["lo"])
    rows = rows.select("word", "n", "size", F.explode(parts).alias("p")).select("word", "n", "size", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))
    return rows.withColumn("key", _key())


def _entries(vocabulary: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Entries (key, word, n, size, lo, hi) whose keys have a pair to verify, and the tables that they rest on. A word owns those of its own size."""
    length = F.char_length("word")
    sizes = F.array(length - 1, length, length + 1)
    level = vocabulary.select("word", "n", F.explode(sizes).alias("size")).where("size > 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("size"))
    leaves, tables = [], []
    while True:
        level = _halved(level)
        owned = F.sum((F.char_length("word") == F.col("size")).cast("bigint"))
        pairs = owned * (F.count(F.lit(1)) - 1)
        wide = F.first(F.col("hi") - F.col("lo")) > 1
        keys = level.groupBy("key").agg(pairs.alias("pairs"), wide.alias("wide")).where("pairs > 0")
        keys = keys.select("key", ((F.col("pairs") > MOST_PAIRS) & F.col("wide")).alias("again"))
        rows = cut(level.join(keys.hint("merge"), "key"), "entries")
        tables.append(rows)
        leaves.append(rows.where("not again").drop("again"))
        level = rows.where("again").drop("again", "key")
        if level.isEmpty():
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, tables


def _common(a: str, b: str, lo: int, hi: int) -> int:
    """How many first signs a and b share, which are at least lo; more than hi aren't looked for."""
    hi = min(hi, len(a), len(b))
    while hi - lo > 64:  # by halves: long words
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    return lo


def one_edit(a: str, b: str, lo: int, hi: int) -> bool:
    """Whether b is a with one sign inserted, deleted or replaced, and the last place where that can be is within lo to hi of a.

    The halves of a word hold that place once, so a pair is found in one entry only.
    """
    if a == b or not a.startswith(b[:lo]):
        return False
    c = _common(a, b, lo, hi)
    if c == hi and hi < len(a):
        return False
    rest = len(a) - len(b)
    return rest in (-1, 0, 1) and a[c + (rest >= 0) :] == b[c + (rest <= 0) :]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, near_n, near) of the words that own entries here: how many near words, and the one of largest n, of ties the smallest."""
    import ahocorasick

    owners: dict[str, list[tuple[str, int, int, bool]]] = {}  # by segment: the word, lo, hi, whether the segment is its beginning
    known: dict[str, int] = {}
    for word, n, size, lo, hi in zip(rows["word"], rows["n"], rows["size"], rows["lo"], rows["hi"], strict=True):
        known[word] = n
        if len(word) == size:
            head = lo >= size - hi
            owners.setdefault(word[:lo] if head else word[hi:], []).append((word, lo, hi, head))
    automaton, short = ahocorasick.Automaton(), owners.pop("", [])
    for segment, held in owners.items():
        automaton.add_word(segment, (len(segment), held))
    automaton.make_automaton()
    found: dict[str, list] = {}

    def meet(v: str, n: int, held: list, begins: bool, ends: bool) -> None:
        for word, lo, hi, head in held:
            if (begins if head else ends) and -2 < len(word) - len(v) < 2 and one_edit(word, v, lo, hi):
                best = found.setdefault(word, [0, 0, ""])
                best[0] += 1
                if n > best[1] or n == best[1] and v < best[2]:
                    best[1:] = n, v

    for v, n in known.items():
        meet(v, n, short, True, True)
        if owners:
            last = len(v) - 1
            for end, (size, held) in automaton.iter(v):
                if end == last or end == size - 1:
                    meet(v, n, held, end == size - 1, end == last)
    return pd.DataFrame([(w, *x) for w, x in found.items()], columns=["word", "n_near", "near_n", "near"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of each word that has a word one edit away; near is the one of largest n, the smallest of ties.

    Words must be distinct and not null, as those of `words` are.
    """
    spark = vocabulary.sparkSession
    entries, tables = _entries(vocabulary)
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("word")), F.lit(0)).alias("signs")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size["n"] // SHARD_ENTRIES + 1, size["signs"] // SHARD_SIGNS + 1)
    found = entries.withColumn("shard", F.pmod(F.col("key"), F.lit(shards))).groupBy("shard").applyInPandas(lambda rows: _shard(rows), "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    out = cut(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")), "near")
    discard(*tables)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following links (word, form) ends. Every round doubles the distance; links must form no circle, and a form's n is larger than its word's, so there is none."""
    at = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(at.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(at)
        at = new
        if at.where("moved").isEmpty():
            return at.drop("moved")


def grouped(vocabulary: DataFrame, least_ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root for each word: the form is the near word of largest n, if that is at least least_ratio times the word's n."""
    if least_ratio < 2:
        raise ValueError("least_ratio must be at least 2, or forms could lead in a circle")
    rows = vocabulary.join(near_words(vocabulary).hint("merge"), "word", "left")
    formed = F.col("near_n") >= least_ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    rows = cut(rows, "forms")
    return rows.join(roots(rows.where("form is not null")).hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all whole texts."""
    return grouped(cut(words(docs), "words")).select("word", "form", "root", "n", "n_near", "form_n")
