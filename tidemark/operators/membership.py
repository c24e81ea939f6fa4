"""Members and their groups: missing and orphaned rows, recurring groups, overlaps of sets, two arms side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of golden sets that one task takes.
ROWS_OF_TASK = 200_000


def without(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in seen; rows with a null key stay."""
    return rows.join(seen.select(key), key, "left_anti")


def pruned(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose owner still exists."""
    return rows.join(owners.select(key), key, "left_semi")


def recurring(members: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, members) of the groups with at least so many members."""
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def best_overlap(golden: DataFrame, detected: DataFrame) -> DataFrame:
    """For each g of golden (g, item) the d of detected (d, item) that shares most items with it, the smallest d of ties.

    Items are identifiers, which few sets have in common: an item's sets of detected go to every set of golden with it, as one row, and shared items
    are counted where a set of golden is whole, so pairs of sets are never shuffled. Tasks are as many as keep the pairs of one bounded; AQE
    doesn't put them together. Sets that share nothing with any other have no row.
    """
    tasks = max(int(golden.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-golden.count() // ROWS_OF_TASK))
    left, right = (side.select(name, "item").repartition(tasks, "item").distinct() for side, name in ((golden, "g"), (detected, "d")))
    owners = right.groupBy("item").agg(F.collect_list(F.struct("d")).alias("ds"))
    dealt = left.join(owners, "item").select("g", "ds").repartition(tasks, "g")
    shared = dealt.select("g", F.explode("ds").alias("of")).groupBy("g", F.col("of.d").alias("d")).agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("g").agg(F.min(F.struct((-F.col("shared")).alias("less"), "d")).alias("m")).select("g", "m.d", (-F.col("m.less")).alias("shared"))
    sizes = best.join(left.groupBy("g").agg(F.count(F.lit(1)).alias("n_g")), "g").join(right.groupBy("d").agg(F.count(F.lit(1)).alias("n_d")), "d")
    ratio = lambda n: F.round(F.col("shared") / n, 6)
    return sizes.select("g", "d", "shared", ratio(F.col("n_g")).alias("recall"), ratio(F.col("n_d")).alias("precision"), ratio(F.col("n_g") + F.col("n_d") - F.col("shared")).alias("iou"))


def arms(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both arms of a comparison by key; a key of one arm only has a null in the other and no difference."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full_outer").select(key, "a", "b", (F.col("b") - F.col("a")).alias("change"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): what only one of the two arms has, each once; a null key is a value like any other."""
    both = a.select(*keys, F.lit(1).alias("s")).unionByName(b.select(*keys, F.lit(2).alias("s")))
    found = both.groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo = hi")
    return found.select(*keys, F.when(F.col("lo") == 1, "a").otherwise("b").alias("side"))


def resolved_totals(members: DataFrame, rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, total): sums over the groups all of whose members have a row; a group with any that has none is left out."""
    found = members.select(group, key).distinct().join(rows.select(key, value, F.lit(True).alias("__found")), key, "left")
    sums = found.groupBy(group).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.count("__found").alias("seen"))
    return sums.where("n = seen").select(group, "total")


def review_first(compared: DataFrame, flagged: Column, floor: float) -> DataFrame:
    """The rows of two arms (see `arms`) that are flagged or changed by at least the floor, the largest changes first."""
    return compared.where(F.coalesce(flagged, F.lit(False)) | (F.abs("change") >= floor)).orderBy(F.desc_nulls_last(F.abs("change")), compared.columns[0])
