"""Clusters of vectors: average linkage, candidates for merging, members that no longer fit, splits by geometry.

The likeness of two groups is the mean dot product of their members, which is the dot product of their mean vectors; so a group is its mean and
its size, and no matrix of all pairs is kept. Likenesses to a merged group lie between those to its halves, so two groups that are each other's
nearest may merge at any time, a group without any likeness at the threshold is done, and a bound on what a group doesn't know of stays a
bound. A round lists for each group its nearest ones, with a bound on all others, by matrix products; from the lists all merges follow that the
bounds leave no doubt of, a few rounds in all. A key with too many vectors for one task has its rounds as jobs, in which blocks are compared two
at a time, until what is left of it fits a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import kept, stored

#: Groups that one task links in rounds of its own, those that a task has the lists of, and those of one block where more are compared: by whole
#: matrices, and by strips for lists.
MOST_IN_TASK, MOST_LISTED, BLOCK, LIST_BLOCK = 20_000, 100_000, 2_000, 16_000
#: Groups whose matrix of likenesses is kept; the products made at a time; the nearest that a list has at most; of so many others the third nearest of one is where a list ends.
MATRIX, PRODUCTS, LISTED, OF_WHICH_ONE = 1_000, 1 << 22, 64, 8
#: Likenesses are compared to so many decimals, so that both sides of a pair see the same.
DECIMALS = 12


def unit(vector: Column) -> Column:
    """The vector at length one; null for null, zero and non-finite vectors."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))

    def divided(n: Column) -> Column:
        return F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), F.transform(x, lambda v: v / n))

    return F.transform(F.array(norm), divided)[0]  # the norm is computed once, not for each element


def chain_groups(means: np.ndarray, sizes: np.ndarray, threshold: float) -> list[list[int]]:
    """Groups of row numbers by average linkage, in order of their first members: a chain of nearest partners, whose last two merge when they are
    each other's nearest; likenesses to the merged group are averages weighted by size. Of equal partners the one before in the chain is
    taken, else the first. Rows merge only at the threshold or above it."""
    n = len(means)
    sim = np.round(means @ means.T, DECIMALS)
    np.fill_diagonal(sim, -np.inf)
    size, active, members = sizes.astype(np.float64).copy(), np.ones(n, bool), [[i] for i in range(n)]
    done, chain = [], []
    while active.any():
        if not chain:
            chain.append(int(active.argmax()))
        tip, before = chain[-1], chain[-2] if len(chain) > 1 else -1
        row = np.where(active, sim[tip], -np.inf)
        near = int(row.argmax())
        if not row[near] >= threshold:  # likenesses only grow along a chain, so none of it can merge
            done += chain
            active[chain] = False
            chain = []
        elif before < 0 or sim[tip, before] < row[near]:
            chain.append(near)
        else:
            root, gone = min(tip, before), max(tip, before)
            merged = (size[root] * sim[root] + size[gone] * sim[gone]) / (size[root] + size[gone])
            sim[root], sim[:, root] = merged, merged
            sim[root, root] = -np.inf
            size[root] += size[gone]
            members[root] += members[gone]
            active[gone] = False
            chain = chain[:-2]
    return [sorted(members[i]) for i in sorted(done)]


def near_lists(one: np.ndarray, other: np.ndarray, at: np.ndarray, over: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one (means named at), ascending, with rows of other (named over) near them and the likenesses, LISTED a row at most; and for each
    row of one a bound, at or above its likeness to all that aren't listed. A bound under the threshold says that the list is whole.

    Products are made in single precision, which is off by `slack` at most, and those near enough again in double precision; where that leaves too
    many, as of vectors that are almost equal, all are.
    """
    k, slack = len(other), (one.shape[1] + 8) * 2.0**-24
    floor, order = threshold - 10.0**-DECIMALS, np.random.default_rng(k).permutation(k)  # so the first are a fair sample
    left, right, names, some = one.astype(np.float32), np.ascontiguousarray(other[order].T, np.float32), over[order], max(3, k // OF_WHICH_ONE)
    strip, bound, found, exact = max(16, min(512, PRODUCTS // k)), np.empty(len(one)), [], None

    def near(s: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        cut = np.full(len(s), floor)
        if k > LISTED:
            cut = np.maximum(cut, np.partition(s[:, :some], some - 3, axis=1)[:, some - 3] - slack)
        return cut, np.flatnonzero(s >= np.nextafter((cut - slack).astype(s.dtype), s.dtype.type(-np.inf))[:, None])

    for lo in range(0, len(one), strip):
        cut, hits = near(left[lo : lo + strip] @ right, slack)
        if len(hits) > 4 * LISTED * len(cut):
            exact = np.ascontiguousarray(other[order].T) if exact is None else exact
            cut, hits = near(one[lo : lo + strip] @ exact, 10.0**-DECIMALS)
        i, j = np.divmod(hits, k)
        i, j = (x[at[lo + i] != names[j]] for x in (i, j))
        j = order[j]
        v, n = np.empty(len(i)), np.bincount(i, minlength=len(cut))
        for x in range(0, len(i), 1 << 16):  # many where vectors are equally far
            v[x : x + (1 << 16)] = np.einsum("ij,ij->i", one[lo + i[x : x + (1 << 16)]], other[j[x : x + (1 << 16)]])
        if (n > LISTED).any():
            by = np.lexsort((over[j], -np.round(v, DECIMALS), i))
            i, j, v = i[by], j[by], v[by]
            place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            last = (place == LISTED - 1) & (n[i] > LISTED)
            cut[i[last]] = np.maximum(cut[i[last]], np.maximum(v[last], threshold + 10.0**-DECIMALS))
            i, j, v = (x[place < LISTED] for x in (i, j, v))
        bound[lo : lo + strip] = cut
        found.append((lo + i, j, v))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), bound


def merge_certain(means: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, threshold: float, scan: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows that are certainly each other's nearest, by chains of nearest partners as in `chain_groups`, and puts means and sizes in place.

    i, j: pairs of rows of which one lists the other; bound: at or above a row's likeness to all that no such pair has. Returns the first member of
    each row's group, and whether the group is done: nothing is near enough to merge with it. Where a nearest partner isn't certain, a chain waits
    for another round; with scan, it is looked for in all rows.
    """
    n, slack = len(means), 2 * 10.0**-DECIMALS
    root, gone, done, waits, bound = np.arange(n), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), bound.copy()
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(a, kind="stable")
    near_by = np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))

    def now(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(y := root[x], x):
            x = y
        return x

    for first in range(n):
        chain = [first] if not (gone[first] or done[first] or waits[first]) else []
        while chain:
            tip, before = chain[-1], chain[-2] if len(chain) > 1 else -1
            known = np.unique(now(near_by[tip]))
            known = near_by[tip] = known[(known != tip) & ~done[known]]
            row = np.round(means[known] @ means[tip], DECIMALS)
            value = row.max(initial=-np.inf)
            sure, whole = value >= bound[tip] - slack, bound[tip] < threshold
            if scan and not (sure or whole):
                known, sure = np.flatnonzero(~(gone | done)), True
                known = known[known != tip]
                row = np.round(means[known] @ means[tip], DECIMALS)
                value = row.max(initial=-np.inf)
            if value < threshold and (sure or whole):  # likenesses only grow along a chain, so none of it can merge
                done[chain] = True
                break
            near = int(known[row.argmax()]) if sure else tip
            if not sure or waits[near]:
                waits[chain] = True
                break
            if before < 0 or not (row[known == before] == value).any():
                chain.append(near)
                continue
            x, y = min(tip, before), max(tip, before)
            size = sizes[x] + sizes[y]
            means[x] = (means[x] * sizes[x] + means[y] * sizes[y]) / size
            bound[x] = (bound[x] * sizes[x] + bound[y] * sizes[y]) / size
            sizes[x], root[y], gone[y] = size, x, True
            near_by[x], near_by[y] = np.concatenate([near_by[x], near_by[y]]), near_by[y][:0]
            chain = chain[:-2] or [x]
    root = now(np.arange(n))
    return root, done[root]


def linked_groups(means: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The first member of each row's group by average linkage: rounds of lists, and a matrix for the last MATRIX rows. Where a round merges few, the
    rest is one chain, which looks through all rows where the lists leave a doubt."""
    means, sizes = means.copy(), sizes.astype(np.float64)
    root, at, scan = np.arange(len(means)), np.arange(len(means)), False  # at: groups that aren't done
    while len(at) > MATRIX:
        some, n = means[at], sizes[at]
        i, j, _, bound = near_lists(some, some, at, at, threshold)
        new, done = merge_certain(some, n, i, j, bound, threshold, scan)
        root[at] = at[new]
        means[at], sizes[at] = some, n
        left = at[(new == np.arange(len(at))) & ~done]
        at, scan = left, len(left) > 0.95 * len(at)
    for group in chain_groups(means[at], sizes[at], threshold):
        root[at[group]] = at[group[0]]
    while not np.array_equal(root[root], root):
        root = root[root]
    return root


def _in_task(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(block, at, root) of groups (block, at, mean, n) that one task has whole."""
    rows = rows.sort_values("at", kind="stable").reset_index(drop=True)
    at = rows["at"].to_numpy()
    return pd.DataFrame({"block": rows["block"], "at": at, "root": at[linked_groups(np.stack(rows["mean"].to_numpy()), rows["n"].to_numpy(), threshold)]})


def _compared(rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, extra: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """work on every two parts of at most about `block` (BLOCK) rows of each block (rows: block, at, mean, and extra): (one part, another, whether they are the same).

    Every row goes to as many tasks as its block has parts. What a task returns must be linear in its rows.
    """
    n = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int").alias("parts"))
    rows = rows.join(n, "block").withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("lo"), F.greatest("part", o).alias("hi")))
    dealt = rows.select("block", "at", "mean", *extra, "part", F.explode(others).alias("o")).select("block", "at", "mean", *extra, "part", "o.lo", "o.hi")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", kind="stable")
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        one = group if lo == hi else group[group["part"] == lo]
        other = group if lo == hi else group[group["part"] == hi]
        return work(one, other, lo == hi) if len(one) and len(other) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return dealt.groupBy("block", "lo", "hi").applyInPandas(run, schema)


def _likeness(one: pd.DataFrame, other: pd.DataFrame) -> np.ndarray:
    return np.round(np.stack(one["mean"].to_numpy()) @ np.stack(other["mean"].to_numpy()).T, DECIMALS)


def _listed(groups: DataFrame, threshold: float) -> DataFrame:
    """(block, at, near, others, sims, bound): each group's list, and the nearest of it, of ties the smallest."""

    def work(one: pd.DataFrame, other: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = []
        for side, over in ((one, other),) if same else ((one, other), (other, one)):
            at, names = side["at"].to_numpy(), over["at"].to_numpy()
            i, j, v, bound = near_lists(np.stack(side["mean"].to_numpy()), np.stack(over["mean"].to_numpy()), at, names, threshold)
            ends = np.searchsorted(i, np.arange(1, len(at)))
            out.append(pd.DataFrame({"block": side["block"].to_numpy(), "at": at, "others": np.split(names[j], ends), "sims": np.split(v, ends), "bound": bound}))
        return pd.concat(out)

    found = _compared(groups, work, "block string, at bigint, others array<bigint>, sims array<double>, bound double", block=LIST_BLOCK)
    found = found.groupBy("block", "at").agg(F.flatten(F.collect_list(F.arrays_zip("others", "sims"))).alias("l"), F.max("bound").alias("bound"))
    found = found.withColumn("l", F.filter("l", lambda x: x["sims"] >= F.col("bound") - 10.0**-DECIMALS))
    nearest = F.array_min(F.transform("l", lambda x: F.struct((-F.round(x["sims"], DECIMALS)).alias("less"), x["others"].alias("other"))))
    return found.select("block", "at", F.coalesce(nearest["other"], F.col("at")).alias("near"), F.col("l.others").alias("others"), F.col("l.sims").alias("sims"), "bound")


def _merged(groups: DataFrame, threshold: float) -> DataFrame:
    """(block, at, root, mean, n): what groups (block, at, mean, n) have merged with in a round; mean is null but for those that may merge further.

    Where a block is dealt to several tasks, those that are each other's nearest meet, and what a task doesn't have counts to the bounds.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        at, bound = rows["at"].to_numpy(), rows["bound"].to_numpy().copy()
        i, names, sims = np.repeat(np.arange(len(at)), rows["others"].map(len)), np.concatenate(rows["others"].to_numpy()).astype(at.dtype), np.concatenate(rows["sims"].to_numpy())
        j = np.minimum(np.searchsorted(at, names), len(at) - 1)
        here = at[j] == names
        np.maximum.at(bound, i[~here], sims[~here])
        means, sizes = np.stack(rows["mean"].to_numpy()), rows["n"].to_numpy().astype(np.float64)
        root, done = merge_certain(means, sizes, i[here], j[here], bound, threshold)
        going = (root == np.arange(len(at))) & ~done
        return pd.DataFrame({"block": rows["block"].to_numpy(), "at": at, "root": at[root], "mean": [m if g else None for m, g in zip(means, going, strict=True)], "n": sizes.astype(np.int64)})

    parts = groups.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MOST_LISTED).alias("parts"))
    # What is made of lists is larger than Spark takes it for, so it is not to be broadcast.
    rows = groups.join(_listed(groups, threshold).hint("merge"), ["block", "at"]).join(parts, "block")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.least("at", "near")), F.col("parts")))
    return rows.groupBy("block", "part").applyInPandas(work, "block string, at bigint, root bigint, mean array<double>, n bigint")


def _in_rounds(groups: DataFrame, threshold: float, most: int) -> DataFrame:
    """(block, at, root) of groups (block, at, mean, n) in blocks too large for a task."""
    groups, roots, small = stored(groups), None, None
    while True:
        step = stored(_merged(groups, threshold))
        if roots is None:
            roots = step.select("block", "at", "root")
        else:
            moved = step.where("at <> root").select("block", F.col("at").alias("root"), F.col("root").alias("into"))
            roots = stored(roots.join(moved.hint("merge"), ["block", "root"], "left").select("block", "at", F.coalesce("into", "root").alias("root")))
        # What is small enough by now, and blocks of which few merge, are done with in tasks.
        left, before = F.count("mean"), F.count(F.lit(1))
        few = (left == before) | (left > before * 0.95) & (before <= MOST_LISTED)
        going = step.where("mean is not null").join(step.groupBy("block").agg(((left <= most) | few).alias("small")), "block")
        ready = going.where("small").select("block", "at", "mean", "n")
        small = ready if small is None else small.unionByName(ready)
        groups = stored(going.where("not small").select("block", "at", "mean", "n"))
        if groups.isEmpty():
            last = small.groupBy("block").applyInPandas(lambda rows: _in_task(rows, threshold), "block string, at bigint, root bigint").select("block", F.col("at").alias("root"), F.col("root").alias("into"))
            return roots.join(last.hint("merge"), ["block", "root"], "left").select("block", "at", F.coalesce("into", "root").alias("root"))


def average_linkage(vectors: DataFrame, keys: list[str], threshold: float = 0.65, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST_IN_TASK) -> DataFrame:
    """(keys, id, root): each key's vectors in groups whose mean cosine is at least the threshold; root is the group's smallest id.

    The two groups of largest mean cosine merge first, until none reach the threshold, which must be above zero. Ids are whole numbers, distinct
    within a key and not null. Vectors that are null, zero or not finite, and those of another length than the key's commonest, are groups of
    one. `most` is how many different vectors one task links; larger keys are merged in rounds until no more are left.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    block = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = vectors.select(*keys, F.col(id_col).cast("bigint").alias("at"), unit(F.col(vector)).alias("mean")).withColumn("block", block)
    lengths = rows.where("mean is not null").groupBy("block", F.size("mean").alias("size")).agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max(F.struct("c", "size")).alias("m"), F.sum("c").alias("all"))
    rows = kept(rows.join(lengths.select("block", F.col("m.size").alias("size"), F.col("m.c").alias("c")), "block", "left"))
    sound = rows.where(F.size("mean") == F.col("size")).select("block", "at", "mean")
    # Equal vectors have the greatest likeness there is, so they are the first to merge: one group, by its smallest id.
    same = sound.groupBy("block", "mean").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")) if threshold <= 1 else sound.select("block", "mean", F.col("at").alias("first"), F.lit(1).cast("bigint").alias("n"))
    same = stored(same.select("block", F.col("first").alias("at"), "mean", "n"))
    counts = same.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    distinct, columns = same.join(counts, "block"), ["block", "at", "mean", "n"]
    found = distinct.where(F.col("c") <= most).select(columns).groupBy("block").applyInPandas(lambda x: _in_task(x, threshold), "block string, at bigint, root bigint")
    large = distinct.where(F.col("c") > most).select(columns)
    if not large.isEmpty():
        found = found.unionByName(_in_rounds(large, threshold, most))
    if threshold <= 1:
        copies = sound.join(same.select("block", "mean", F.col("at").alias("first")), ["block", "mean"]).select("block", "at", "first")
        found = copies.join(found.withColumnRenamed("at", "first"), ["block", "first"]).select("block", "at", "root")
    out = rows.select("block", *keys, "at").join(found, ["block", "at"], "left")
    return out.select(*keys, F.col("at").alias(id_col), F.coalesce("root", "at").alias("root"))


def mean_vectors(members: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, mean, n): the mean of each key's unit vectors at length one, null if there is none or they cancel out. Sums are combined before the shuffle, one row a dimension."""
    rows = members.select(key, F.posexplode(unit(F.col(vector))).alias("dim", "x"))
    sums = rows.groupBy(key, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("c"))
    out = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("v"), F.max("c").alias("n"))
    return out.select(key, unit(F.col("v.s")).alias("mean"), "n")


def member_likeness(members: DataFrame, key: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, id, sim): each member's cosine to its key's mean vector; null without a direction."""
    rows = members.select(key, id_col, unit(F.col(vector)).alias("x")).join(mean_vectors(members, key, vector), key, "left")
    return rows.select(key, id_col, F.aggregate(F.zip_with("x", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("sim"))


def evicted(sims: DataFrame, key: str, id_col: str = "vec_id", floor: float = 0.6, most: int = 10) -> DataFrame:
    """(key, id, sim): members (key, id, sim) to move out: those under the floor, but never a cluster's best (of ties the smallest id), and none of a
    cluster with fewer than two. Clusters go in order of their key and members of their id, until `most` have moved."""
    sound = sims.where("sim is not null")
    best = sound.groupBy(key).agg(F.min(F.struct((-F.col("sim")).alias("less"), F.col(id_col).alias("best"))).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    out = sound.where(F.col("sim") < floor).join(best.select(key, "b.best"), key).where(F.col(id_col) != F.col("best"))
    return out.select(key, id_col, "sim").orderBy(key, id_col).limit(most)


def incoherent(sims: DataFrame, key: str, floor: float = 0.85, most: int = 5) -> DataFrame:
    """(key, coherence, members): clusters of two or more whose mean likeness is under the floor, the worst first."""
    rows = sims.where("sim is not null").groupBy(key).agg(F.avg("sim").alias("coherence"), F.count(F.lit(1)).alias("members"))
    return rows.where((F.col("members") >= 2) & (F.col("coherence") < floor)).orderBy("coherence", key).limit(most)


def merge_candidates(means: DataFrame, key: str, touched: DataFrame, declined: DataFrame, floor: float = 0.55, most: int = 15) -> DataFrame:
    """(a, b, sim), a < b: pairs of clusters of which one at least is touched (key), whose means (key, mean) are at the floor or above, without those
    declined (a, b); the likest first, at most `most`. Blocks are compared by matrix products, and each returns no more than it may."""
    rows = means.where("mean is not null").join(touched.select(key).distinct().withColumn("touched", F.lit(True)), key, "left")
    rows = rows.select(F.lit("").alias("block"), F.col(key).cast("bigint").alias("at"), "mean", F.coalesce("touched", F.lit(False)).alias("touched"))
    # A declined pair may hold a place in a block's list, so lists are longer by as many as any cluster has declined.
    held = declined.select("a").union(declined.select("b")).groupBy("a").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("m"), F.coalesce(F.sum("count"), F.lit(0)).alias("s")).first()
    room = most + held["s"]

    def work(one: pd.DataFrame, other: pd.DataFrame, same: bool) -> pd.DataFrame:
        sim = _likeness(one, other)
        ok = (sim >= floor) & (one["touched"].to_numpy()[:, None] | other["touched"].to_numpy()[None, :])
        if same:
            ok &= np.triu(np.ones_like(ok), 1)
        i, j = np.nonzero(ok)
        a, b = one["at"].to_numpy()[i], other["at"].to_numpy()[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a, -sim[i, j]))[:room]
        return pd.DataFrame({"a": a[order], "b": b[order], "sim": sim[i, j][order]})

    found = _compared(rows, work, "a bigint, b bigint, sim double", ("touched",))
    return found.join(declined.select("a", "b").distinct(), ["a", "b"], "left_anti").orderBy(F.desc("sim"), "a", "b").limit(most)


def resplit(members: DataFrame, key: str, threshold: float = 0.65, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, id, part): each cluster's members by average linkage. The largest group (of ties the one with the smallest member) keeps the cluster, part
    null, and so do members without a direction; every other group is a part, named by its smallest member. A cluster of one group stays."""
    groups = average_linkage(members, [key], threshold, id_col, vector)
    placed = groups.join(members.select(key, id_col, unit(F.col(vector)).isNotNull().alias("sound")), [key, id_col])
    sizes = placed.where("sound").groupBy(key, "root").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "root"))
    rest = sizes.withColumn("place", first).where("place > 1").select(key, "root", F.col("root").alias("part"))
    return placed.join(rest, [key, "root"], "left").select(key, id_col, F.when(F.col("sound"), F.col("part")).alias("part"))
