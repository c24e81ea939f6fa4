"""One-to-one matching of segments by overlap, greedily from the best pair on, and blocks that steps of a script claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import contained
from tidemark.sources.tables import kept


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str, slot_ms: int) -> DataFrame:
    """(key, a, b, overlap_ms, ratio): segments (key, start_ms, end_ms, id) of the two sides that share time; ratio is of the shorter one, which counts 1 ms at least.

    Two segments that share time have one's start within the other, so two range joins find all pairs and no other is formed.
    """

    def sides(points: DataFrame, spans: DataFrame, equal: bool) -> DataFrame:
        p = points.select(key, F.col("start_ms").alias("t"), "id", F.col("end_ms").alias("p_end"))
        w = spans.select(key, "start_ms", "end_ms", F.col("id").alias("window"))
        found = contained(p, w, key, slot_ms)
        return found if equal else found.where("t > start_ms")

    one = sides(left, right, True).select(key, F.col("id").alias("a"), F.col("window").alias("b"), F.col("t").alias("a0"), F.col("p_end").alias("a1"), F.col("start_ms").alias("b0"), F.col("end_ms").alias("b1"))
    two = sides(right, left, False).select(key, F.col("window").alias("a"), F.col("id").alias("b"), F.col("start_ms").alias("a0"), F.col("end_ms").alias("a1"), F.col("t").alias("b0"), F.col("p_end").alias("b1"))
    both = one.unionByName(two).withColumn("overlap_ms", F.least("a1", "b1") - F.greatest("a0", "b0")).where("overlap_ms > 0")
    return both.select(key, "a", "b", "overlap_ms", (F.col("overlap_ms") / F.greatest(F.lit(1), F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")))).alias("ratio"))


def greedy(pairs: DataFrame, order: list[Column], group: list[str], left: str = "a", right: str = "b") -> DataFrame:
    """The pairs that remain if the first by `order` is taken, all others of its two ends go, and so on, within each group.

    In rounds: a pair that is first for both of its ends is taken, whatever stands elsewhere, so each round takes many. `order`, and then left and
    right, tells all pairs apart. Every round at least takes the first pair of each group.
    """
    rows = kept(pairs.withColumn("__o", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(left).alias("l"), F.col(right).alias("r"))))
    out = None
    while True:
        by = lambda end: F.min("__o").over(Window.partitionBy(*group, end))
        first = kept(rows.withColumn("__l", by(left)).withColumn("__r", by(right)).where((F.col("__o") == F.col("__l")) & (F.col("__o") == F.col("__r"))).drop("__l", "__r"))
        out = first if out is None else out.unionByName(first)
        rows = rows.join(first.select(*group, left), [*group, left], "left_anti").join(first.select(*group, right), [*group, right], "left_anti")
        rows = kept(rows.select(*pairs.columns, "__o"))
        if rows.isEmpty():
            return out.drop("__o")


def matched_segments(golden: DataFrame, produced: DataFrame, key: str, slot_ms: int, least: float = 0.3) -> DataFrame:
    """(key, a, b, overlap_ms, ratio): golden and produced segments (key, start_ms, end_ms, id, title) matched one to one, of the largest ratio first, then of equal titles, then by ids."""
    pairs = overlapping_pairs(golden, produced, key, slot_ms).where(F.col("ratio") >= least)
    titles = pairs.join(golden.select(key, F.col("id").alias("a"), F.col("title").alias("__ta")), [key, "a"]).join(produced.select(key, F.col("id").alias("b"), F.col("title").alias("__tb")), [key, "b"])
    same = F.coalesce((F.col("__ta") == F.col("__tb")) & (F.col("__ta") != ""), F.lit(False)).cast("int")
    found = greedy(titles.withColumn("__same", same).drop("__ta", "__tb"), [-F.col("ratio"), -F.col("__same")], [key])
    return found.select(key, "a", "b", "overlap_ms", "ratio")


def segment_report(golden: DataFrame, produced: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, golden, produced, matched, coverage, missed, extra): of each key that has segments; coverage is null where there is no golden one."""
    parts = [golden.select(key, F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("m")), produced.select(key, F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("m")), matches.select(key, F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("m"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(F.sum("g").alias("golden"), F.sum("p").alias("produced"), F.sum("m").alias("matched"))
    return rows.select("*", F.round(F.when(F.col("golden") > 0, F.col("matched") / F.col("golden")), 6).alias("coverage"), (F.col("golden") - F.col("matched")).alias("missed"), (F.col("produced") - F.col("matched")).alias("extra"))


def claimed_blocks(steps: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, step, claimed, target): each step (key, step, at, app) claims the blocks (key, id, start_ms, end_ms, app) of its app that start before the next step; the
    longest, of equal ones the first, is its target, null where none fits. Of steps at one time the last by id has the time after it."""
    both = steps.select(key, F.col("at").alias("t"), F.lit(0).alias("side"), F.col("step").alias("id"), F.col("app"), F.lit(None).cast("bigint").alias("len"))
    both = both.unionByName(blocks.select(key, F.col("start_ms").alias("t"), F.lit(1).alias("side"), "id", "app", (F.col("end_ms") - F.col("start_ms")).alias("len")))
    w = Window.partitionBy(key).orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("side") == 0, F.struct(F.col("id").alias("step"), F.col("app").alias("app"))), ignorenulls=True).over(w)
    placed = both.withColumn("own", own).where((F.col("side") == 1) & F.col("own").isNotNull() & (F.col("own.app") == F.col("app")))
    best = placed.groupBy(key, F.col("own.step").alias("step")).agg(F.count(F.lit(1)).alias("claimed"), F.min(F.struct((-F.col("len")).alias("less"), "t", "id")).alias("b"))
    return steps.select(key, "step").join(best.select(key, "step", "claimed", F.col("b.id").alias("target")), [key, "step"], "left").select(key, "step", F.coalesce("claimed", F.lit(0)).cast("bigint").alias("claimed"), "target")
