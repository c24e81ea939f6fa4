"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard


def _large_star(e: DataFrame) -> DataFrame:
    """Each vertex hangs its larger neighbours on the smallest vertex near it."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours hang on the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every vertex of the edge table (u, v) but the smallest of each component, whose name is that smallest vertex.

    Edges may repeat, in either direction; loops and edges with a null end are left out. No vertex's edges are gathered in one place: the
    rounds are grouped minima and equi-joins, and each round ends in a table in the shared folder.
    """
    e = cut(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges")
    before = None
    while True:  # every round but the last brings a vertex nearer to its component's smallest
        last, e = e, cut(_small_star(_large_star(e)), "stars")
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select("u", F.col("v").alias("component"))
        before = now
