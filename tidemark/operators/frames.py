"""Frames told apart by how they look: difference hashes, luminance, and thinning of frames that look like the last one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals, profile
from tidemark.streaming import folds
from tidemark.streaming.folds import NEVER


def difference_hash(gray: Column) -> Column:
    """A bit for each two neighbours of an array of gray levels, 1 where they rise; empty for fewer than two."""
    n = F.size(gray)
    rising = F.zip_with(F.slice(gray, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(gray, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a < b, "1").otherwise("0"))
    return F.array_join(rising, "")


def hash_difference(a: Column, b: Column) -> Column:
    """Bits that differ, in per cent; null for empty hashes or two lengths."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), same * 100.0 / F.length(a))


def luminance_difference(a: Column, b: Column) -> Column:
    """Mean difference of two arrays of gray levels (0 to 255), in per cent; null for empty ones or two sizes."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), total / F.size(a) / 255 * 100)


def _unlike(a: str | None, b: str | None) -> float | None:
    return sum(x != y for x, y in zip(a, b, strict=True)) * 100 / len(a) if a and b and len(a) == len(b) else None


class Thinner:
    """Records (at, id, hash). Holds the frame kept last and the newest one, which may turn out to be the last of all."""

    def __init__(self, least: float) -> None:
        self.least, self.kept, self.many, self.new = least, None, 0, None

    def due(self) -> int:
        return NEVER

    def advance(self, now: int) -> list[tuple]:
        return []

    def take(self, record: tuple) -> list[tuple]:
        if self.kept is None:
            self.kept, self.many = record, 1
            return []
        middle, self.new = self.new, record
        if middle is None:
            return []
        far = _unlike(self.kept[2], middle[2])
        if self.least > 0 and far is not None and far < self.least:
            return []
        out, self.kept = self.kept, middle
        self.many += 1
        return [out[:2]]

    def end(self) -> list[tuple]:
        if self.new is None:
            return [self.kept[:2]]
        far = _unlike(self.kept[2], self.new[2])
        alike = self.least > 0 and far is not None and far < self.least and self.many > 1
        return [self.new[:2]] if alike else [self.kept[:2], self.new[:2]]


def thinned(frames: DataFrame, key: str, least: float) -> DataFrame:
    """(key, at, id): of each key's frames (at, id, hash) in order the first, each that differs by `least` per cent from the one kept before it, and the last.

    The last takes the place of the one before it if they look alike, unless that is the first. Frames without a hash, or with one of another
    length, are kept. A task holds two frames of a key at a time.
    """
    return folds.batch(frames.select(key, "at", "id", "hash"), [key], ["at", "id", "hash"], lambda k: Thinner(least), "at bigint, id bigint")


def leaked_tails(frames: DataFrame, after: DataFrame, keys: list[str], candidates: int = 3, references: int = 2, margin: float = 0.5) -> DataFrame:
    """(keys, id): last frames of an activity (keys, at, id, gray) that show what comes after it: from the end back, those whose luminance is nearer by more
    than `margin` per cent to one of the first frames after it (keys, at, id, gray) than to one of its own just before the candidates.

    At most `candidates` frames are looked at and never all; the first that isn't nearer, or can't be compared, ends the tail. Only the last few
    frames of an activity, and the first few after it, are gathered.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("id"))
    rows = frames.withColumn("r", F.row_number().over(newest)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("r") <= candidates + references)
    rows = rows.withColumn("many", F.least(F.lit(candidates), F.col("n") - 1))
    own = rows.where((F.col("r") > F.col("many")) & (F.col("r") <= F.col("many") + references)).groupBy(*keys).agg(F.collect_list("gray").alias("own"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "id"))
    next_ = after.withColumn("r", first).where(F.col("r") <= references).groupBy(*keys).agg(F.collect_list("gray").alias("next"))
    tail = rows.where(F.col("r") <= F.col("many")).join(own, keys).join(next_, keys)
    nearest = lambda refs: F.array_min(F.transform(refs, lambda g: luminance_difference(F.col("gray"), g)))
    leaks = F.coalesce(nearest(F.col("next")) - nearest(F.col("own")) < -margin, F.lit(False))
    so_far = F.min(leaks.cast("int")).over(Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return tail.withColumn("gone", so_far).where("gone = 1").select(*keys, "id")


def snapshots(frames: DataFrame, anchors: DataFrame, key: str, most: int, least: float = 0.0) -> DataFrame:
    """(key, at, id): at most `most` frames (key, at, id, hash) of each key: the first, the last, and those nearest to the anchors (key, t; of ties the earlier), thinned by
    how they look, and then, if there are still too many, the first, the last and evenly spaced ones between.

    Of frames of one time the smallest id stands for all. `most` under 1 counts as 1, which gives the first frame. Anchors of keys without
    frames give nothing.
    """
    one = frames.groupBy(key, "at").agg(F.min(F.struct("id", "hash")).alias("f")).select(key, "at", "f.id", "f.hash")
    near = intervals.as_of(anchors.select(key, "t").distinct(), one.select(key, F.col("at").alias("t")), key).select(key, F.col("match").alias("at"))
    ends = one.groupBy(key).agg(F.array(F.min("at"), F.max("at")).alias("e")).select(key, F.explode("e").alias("at"))
    chosen = one.join(near.where("at is not null").union(ends).distinct(), [key, "at"], "left_semi")
    rows = thinned(chosen, key, least).withColumn("start_ms", F.col("at"))
    return profile.spaced(rows, max(1, most), key).select(key, "at", "id")
