"""Counts by state and week, spreads, runs of equal values, gates carried forward, retrieval scores, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import DAY_MS, day_of


def count_by(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """How many rows have each of the states; a state that none has counts 0, other states are left out."""
    spine = rows.sparkSession.createDataFrame([(s,) for s in states], f"{column} string")
    counts = rows.where(F.col(column).isin(states)).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return spine.join(counts, column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def weekly_counts(acts: DataFrame, now_ms: int, weeks: int = 4) -> DataFrame:
    """Activities of each of the last weeks, from Mondays on, zero-filled; older and later ones are ignored."""
    week = F.floor((day_of(F.col("start_ms")) + 3) / 7)
    last = (now_ms // DAY_MS + 3) // 7
    counts = acts.where((week > last - weeks) & (week <= last)).groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("c"))
    spine = acts.sparkSession.range(last - weeks + 1, last + 1).withColumnRenamed("id", "week")
    return spine.join(counts, "week", "left").select((F.col("week") * 7 - 3).alias("monday"), F.coalesce("c", F.lit(0)).alias("n"))


def spread(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Median length, and the days from the first to the last start, both counted."""
    return acts.groupBy(*keys).agg(F.median(F.col("end_ms") - F.col("start_ms")).alias("median_ms"), (F.floor((F.max("start_ms") - F.min("start_ms")) / DAY_MS) + 1).alias("span_days"))


def run_lengths(acts: DataFrame, column: str, key: str = "user_id") -> DataFrame:
    """(key, run, column, n): runs of equal neighbours in time order; nulls are equal to nulls."""
    w = Window.partitionBy(key).orderBy("start_ms", "id")
    first = F.when(F.row_number().over(w) == 1, 1).when(F.lag(column).over(w).eqNullSafe(F.col(column)), 0).otherwise(1)
    return acts.withColumn("__first", first).withColumn("run", F.sum("__first").over(w)).groupBy(key, "run", column).agg(F.count(F.lit(1)).alias("n"))


def changes_only(acts: DataFrame, columns: list[str], key: str = "user_id") -> DataFrame:
    """Without the rows that repeat all these columns of the row before."""
    w = Window.partitionBy(key).orderBy("start_ms", "id")
    same = F.row_number().over(w) > 1
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return acts.withColumn("__same", same).where("not __same").drop("__same")


def gated(acts: DataFrame, decides: Column, blocked: Column, key: str = "user_id") -> DataFrame:
    """The rows outside blocked stretches: a row that decides sets the state, which holds until the next such row."""
    w = Window.partitionBy(key).orderBy("start_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(decides, blocked), ignorenulls=True).over(w)
    return acts.withColumn("__blocked", F.coalesce(state, F.lit(False))).where("not __blocked").drop("__blocked")


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    """Mean reciprocal rank up to 10, and recall at 1 and 10, of each query's first hit; a null rank is a miss."""
    r = F.col("rank")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return ranks.agg(F.round(F.avg(F.when(r <= 10, 1.0 / r).otherwise(0.0)), 6).alias("mrr10"), share(r <= 1).alias("r1"), share(r <= 10).alias("r10"), F.count(F.lit(1)).alias("queries"))


def stratified(rows: DataFrame, stratum: str, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows taken in turn from all strata, within one by a hash of seed and id. Ranks beyond n are cut before the shuffle."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    w = Window.partitionBy(stratum).orderBy(draw, id_col)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)
