"""Prefix tries of conversations: which openings they share, and what sharing them saves.

A conversation is the sequence of its turns' digests. Equal conversations are one sequence with a count, so copies cost nothing. Sequences are
dealt by the digest of their first turn; each deal builds its tries inside applyInPandas, nodes as pointers in one dictionary, and sums up
subtrees from the last node to the first, which is a postorder without recursion. A first turn with too many sequences is not dealt: its
nodes up to where its sequences part are told by sums, and its sequences are dealt again by the next turn, as often as needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, cut, discard

#: Turns of sequences that one task builds tries of, and conversations whose ids one row lists.
MOST_TURNS, MOST_IDS = 20_000, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, seq string, key string, up string"


def _digest(turns: Column) -> Column:
    """128 bits of SHA-256, in hex, of an array of digests."""
    return F.substring(F.sha2(F.array_join(turns, ",").cast("binary"), 256), 1, 32)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): digests of each conversation's turns in order, and the words of their texts.

    Turns go by number, null first; of equal numbers by digest. A null role or text is empty. Rows without a conversation are left out.
    Repeated rows are turns each. A conversation is one row of 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).alias("words")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.digest").alias("path"), F.col("t.words").alias("words"))


def rebuilt(convs: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % block (all if it has fewer, none if there is no such one), then
    go its own after the first h; h is the crc32 of c in decimals, modulo heads."""
    most = heads - 1
    base = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("base_path"), F.slice("words", 1, most).alias("base_words"))
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    rows = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))

    def spliced(name: str) -> Column:
        none = F.array().cast("array<int>" if name == "words" else "array<string>")
        head = F.coalesce(F.expr(f"slice(base_{name}, 1, h)"), none)
        return F.concat(head, F.expr(f"slice({name}, h + 1, greatest(size({name}) - h, 0))")).alias(name)

    return rows.select("conv_id", spliced("path"), spliced("words"))


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of sequences (key, depth, up, up_first, path, words, seq, n, first), from the turn on that depth tells."""
    child: dict[tuple[int | str, str], int] = {}
    parent, depth, count, first, words, seq, kids, top = [], [], [], [], [], [], [], []
    for key, start, up, up_first, path, said, name, n, least in rows.itertuples(index=False):
        at: int | str = key
        for i in range(start - 1, len(path)):
            node = child.get((at, path[i]))
            if node is None:
                node = child[at, path[i]] = len(parent)
                root = isinstance(at, str)
                parent.append(-1 if root else at)
                top.append((key, up, up_first) if root else None)
                depth.append(i + 1)
                words.append(said[i])
                count.append(0)
                first.append(least)
                seq.append(None)
                kids.append(0)
                if not root:
                    kids[at] += 1
            count[node] += n
            first[node] = min(first[node], least)
            at = node
        seq[at] = name
    leaves, saved = [int(k == 0) for k in kids], [(n - 1) * int(w) for n, w in zip(count, words, strict=True)]
    for node in range(len(parent) - 1, -1, -1):  # children come after their parents
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    out = []
    for node, up in enumerate(parent):
        key, above, least = top[node] or (None, None, None)
        out.append((first[node], depth[node], first[up] if up >= 0 else least, count[node], kids[node], leaves[node], saved[node], seq[node], key, above))
    return pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq", "key", "up"])


def _dealt(rows: DataFrame, load: int, most: int) -> DataFrame:
    """Tries of rows whose keys are small."""
    deals = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), load // most + 1)
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(deals)))
    columns = ["key", "depth", "up", "up_first", "path", "words", "seq", "n", "first"]
    return rows.groupBy("deal").applyInPandas(lambda x: _tries(x[columns]), _NODES)


def _segments(rows: DataFrame) -> DataFrame:
    """(key, depth, up, up_first, n, first, turn_words, ends): of each key its nodes from depth on to where its sequences part. They share their words;
    `last` is the depth of the last, and ends the sequence that ends there, if one does."""
    least, most = F.min(F.struct("path", "words", "seq")).alias("lo"), F.max("path").alias("hi")
    rows = rows.groupBy("key", "depth", "up", "up_first").agg(F.sum("n").alias("n"), F.min("first").alias("first"), least, most)
    # What the first and the last sequence of an order share is shared by all.
    part = F.array_position(F.zip_with("lo.path", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    rows = rows.withColumn("last", F.when(part > 0, part - 1).otherwise(F.size("lo.path")).cast("int"))
    said = F.expr("slice(lo.words, depth, last - depth + 1)")
    return rows.select("key", "depth", "last", "up", "up_first", "n", "first", said.alias("said"), F.when(F.size("lo.path") == F.col("last"), F.col("lo.seq")).alias("ends"))


def _upper(segments: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of segments, when what lies below their last node is known: (up, leaves, saved, kids)."""
    rows = segments.join(below.withColumnRenamed("up", "key"), "key", "left")
    rows = rows.select("*", F.posexplode("said").alias("i", "w")).withColumn("depth", F.col("depth") + F.col("i"))
    under = Window.partitionBy("key").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last, begins = F.col("depth") == F.col("last"), F.col("i") == 0
    kids, leaves, saved = (F.coalesce(x, F.lit(0)) for x in ("kids", "leaves", "saved"))
    return rows.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.when(begins, F.col("up_first")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, kids).otherwise(F.lit(1)).cast("bigint").alias("n_children"), F.greatest(leaves, F.lit(1)).cast("bigint").alias("n_leaves"),
        (saved + F.sum((F.col("n") - 1) * F.col("w")).over(under)).cast("bigint").alias("saved_tokens"), F.when(last, F.col("ends")).alias("seq"), F.when(begins, F.col("key")).alias("key"), F.when(begins, F.col("up")).alias("up"),
    )


def _ends(convs: DataFrame) -> DataFrame:
    """(seq, ends_sha256): of the ids of each sequence's conversations. Ids are listed in rows of bounded size, and these are hashed one after another."""
    listed = convs.groupBy("seq", F.floor(F.col("conv_id") / MOST_IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    rows = listed.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, out = None, sha256(), []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == seq:
                    state.update(b",")
                else:
                    if seq is not None:
                        out.append((seq, state.hexdigest()))
                    seq, state = name, sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"seq": pa.array([x for x, _ in out], pa.string()), "ends_sha256": pa.array([x for _, x in out], pa.string())})
            out = []
        if seq is not None:
            yield pa.RecordBatch.from_pydict({"seq": [seq], "ends_sha256": [state.hexdigest()]})

    return rows.mapInArrow(run, "seq string, ends_sha256 string")


def prefix_trie(convs: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """Nodes of conversations (conv_id, path, words): conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. No conversation gives no node; conversations without turns are members of the root.

    conv_id must be distinct and not null. Equal digests count as equal turns.
    """
    spark = convs.sparkSession
    arrow_limits(spark)
    convs = cut(convs.withColumn("seq", _digest(F.col("path"))), "conversations")
    seqs = cut(convs.groupBy("seq").agg(F.min(F.struct("conv_id", "path", "words")).alias("m"), F.count(F.lit(1)).alias("n")).select("seq", "n", F.col("m.conv_id").alias("first"), "m.path", "m.words"), "sequences")
    whole = seqs.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.size("path")).alias("load")).first()
    if whole["n"] is None:
        return spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    none = F.lit(None)
    root = spark.range(1).select(F.lit("").alias("key"), F.lit(0).alias("depth"), F.lit(0).alias("last"), none.cast("string").alias("up"), none.cast("bigint").alias("up_first"), F.lit(whole["n"]).cast("bigint").alias("n"), F.lit(whole["first"]).cast("bigint").alias("first"), F.array(F.lit(0)).alias("said"), F.lit(_EMPTY).alias("ends"))
    level = seqs.where(F.size("path") > 0).select(F.element_at("path", 1).alias("key"), F.lit(1).alias("depth"), F.lit("").alias("up"), F.lit(whole["first"]).cast("bigint").alias("up_first"), "path", "words", "seq", "n", "first")
    segments, nodes, held = [root], [], []
    while True:
        load = F.sum(F.size("path") - F.col("depth") + 1)
        big = cut(level.groupBy("key").agg(load.alias("load"), F.count(F.lit(1)).alias("seqs")).where((F.col("load") > most_turns) & (F.col("seqs") > 1)).select("key", F.lit(True).alias("big")), "big")
        last = big.isEmpty()
        rows = level if last else level.join(big, "key", "left")
        if not last:
            rows = cut(rows, "dealt")
            held.append(rows)
        small = rows if last else rows.where("big is null").drop("big")
        nodes.append(cut(_dealt(small, whole["load"], most_turns), "nodes"))
        discard(big)
        if last:
            break
        large = rows.where("big").drop("big")
        segments.append(cut(_segments(large), "segments"))
        at = segments[-1].select(F.col("key").alias("up"), "last", F.col("first").alias("up_first"))
        level = large.drop("up", "up_first").withColumnRenamed("key", "up").join(at, "up").where(F.size("path") > F.col("last"))
        level = level.select(_digest(F.expr("slice(path, 1, last + 1)")).alias("key"), (F.col("last") + 1).alias("depth"), "up", "up_first", "path", "words", "seq", "n", "first")
    for k in range(len(segments) - 1, -1, -1):  # from the deepest level up
        tops = nodes[k] if k + 1 == len(segments) else nodes[k].unionByName(nodes[-1])
        below = tops.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("kids"))
        nodes.append(cut(_upper(segments[k], below), "upper"))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    out = out.drop("key", "up")
    ended = out.where("seq is not null").join(_ends(convs), "seq", "left")
    through = out.where("seq is null").withColumn("ends_sha256", F.lit(None).cast("string"))
    discard(seqs, *held, *segments[1:])
    return ended.unionByName(through).drop("seq").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))


#: The digest of a sequence without turns.
_EMPTY = sha256(b"").hexdigest()[:32]


def report(turns: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    return prefix_trie(rebuilt(conversations(turns)))
