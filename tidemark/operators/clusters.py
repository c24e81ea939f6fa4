"""The store of clusters: digests of members, recurring labels, pruning of orphans, cited ids, merged provenance, short names for ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import kept


def digest(memberships: DataFrame, sightings: DataFrame, cluster: int | None = None) -> DataFrame:
    """Members (cluster, and the columns of sightings) with their place in the order of their start, of one cluster or of all: one join, whatever the number of clusters."""
    own = memberships if cluster is None else memberships.where(F.col("cluster") == cluster)
    w = Window.partitionBy("cluster").orderBy("start_ms", "id")
    return own.select("cluster", "id").distinct().join(sightings, "id").withColumn("place", F.row_number().over(w))


def recurring_labels(clusters: DataFrame, memberships: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, label, seen): labelled clusters with at least so many members. Members are counted before they are joined."""
    counts = memberships.groupBy("cluster").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= least)
    return clusters.where(F.coalesce("label", F.lit("")) != "").select("cluster", "label").join(counts, "cluster")


@dataclass
class Pruned:
    """What stays after pruning, and the clusters that lost a member and still have some."""

    memberships: DataFrame
    signatures: DataFrame
    clusters: DataFrame
    touched: DataFrame


def pruned(clusters: DataFrame, memberships: DataFrame, signatures: DataFrame, sightings: DataFrame) -> Pruned:
    """Memberships and signatures (id) of sightings that are gone go, then clusters without any member."""
    there = sightings.select("id").distinct()
    stay = memberships.join(there, "id", "left_semi")
    lost = memberships.join(there, "id", "left_anti").select("cluster").distinct()
    alive = stay.select("cluster").distinct()
    return Pruned(stay, signatures.join(there, "id", "left_semi"), clusters.join(alive, "cluster", "left_semi"), lost.join(alive, "cluster", "left_semi"))


def cited(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, ids, ...) with only those of their ids that known (keys, id) has, each once, in their order; without any they go."""
    rows = kept(candidates.withColumn("__row", F.monotonically_increasing_id()))  # numbered once
    each = rows.select("__row", *keys, F.posexplode("ids").alias("pos", "id")).groupBy("__row", *keys, "id").agg(F.min("pos").alias("pos"))
    found = each.join(known.select(*keys, "id").distinct(), [*keys, "id"], "left_semi").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
    return rows.drop("ids").join(found, "__row").withColumn("ids", F.col("l.id")).drop("l", "__row")


def merged_lists(parts: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """(keys, lists): the union of each list over a key's rows, each entry once, sorted. Entries are told apart before lists are made."""
    out = parts.select(*keys).distinct()
    for name in lists:
        each = parts.select(*keys, F.explode(name).alias("x")).where("x is not null").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias(name))
        out = out.join(each, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(parts.schema[name].dataType)))
    return out


def aliases(rows: DataFrame, group: list[str], order: list[str], id_col: str = "id") -> DataFrame:
    """(group, id, alias): short names a1, a2, ... of each group's ids in the order in which they first come."""
    first = rows.where(F.col(id_col).isNotNull()).groupBy(*group, id_col).agg(F.min(F.struct(*order)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("first", id_col))
    return first.select(*group, id_col, F.concat(F.lit("a"), place.cast("string")).alias("alias"))


def unaliased(rows: DataFrame, names: DataFrame, group: list[str], alias: str = "alias", id_col: str = "id") -> DataFrame:
    """rows with the id of their alias; rows whose alias nobody has go. Case and blanks around don't matter."""
    return rows.withColumn("__a", F.lower(F.trim(alias))).join(names.select(*group, F.col("alias").alias("__a"), id_col), [*group, "__a"]).drop("__a")
