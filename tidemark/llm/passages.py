"""Removal of repeated passages with a log-structured index of window fingerprints.

A passage window is 20 consecutive words. Each contains 15 runs of 6 words, and the one with the least hash is its anchor: equal windows
have equal anchors, at the same place. The index holds the anchors of all earlier documents as sorted, immutable runs. A new batch becomes a
sorted run of its own and is merge-joined with the earlier ones; windows whose anchor is seen again are verified by two hashes of all their
words (96 bits, besides the anchor's 64), earlier documents' windows too, and marked if they start earlier elsewhere. Runs of equal level are
compacted into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RangeHash, arrow_limits, bucketed, chunks, cut, discard, read_bucketed, shared_dir, texts_of, with_columns, written

WIDTH, ANCHOR = 20, 6
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 2 << 20


class _Windows:
    """The windows of some texts, and each one's anchor (the number of a word)."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        words = [x.split() for x in texts]
        self.text = np.array([i for i, w in enumerate(words) if len(w) >= width], np.int64)
        self.size = np.array([len(words[i]) for i in self.text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.anchor = self.start = np.zeros(0, np.int64)
        if not len(self.text):
            return
        self.data = np.frombuffer(b" ".join(b" ".join(words[i]) for i in self.text) + b" ", np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.hash = RangeHash(self.data, _BASES[0])
        size = min(ANCHOR, width)
        h = self.hash.of(self.starts[: len(self.starts) - size + 1], self.ends[size - 1 :])
        least = np.lib.stride_tricks.sliding_window_view(h, width - size + 1).argmin(1)
        owner = np.repeat(np.arange(len(self.text)), self.size)
        self.start = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
        self.anchor = self.start + least[self.start]
        self.anchor_hash, self.owner, self.width = h, owner, width

    def digest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start at these words."""
        lo, hi = self.starts[at], self.ends[at + self.width - 1]
        return self.hash.of(lo, hi).view(np.int64), (RangeHash(self.data, _BASES[1]).of(lo, hi) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _repeat(column: pa.Array, index: np.ndarray) -> pa.Array:
    return column.take(pa.array(index))


def anchors(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(h, id, version, pos): hash and word number of each anchor of docs (id, version, text)."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for lo, hi in chunks(texts, _CHUNK):
                w = _Windows(texts[lo:hi], width)
                if len(w.start):
                    at = np.unique(w.anchor)
                    own = w.owner[at]
                    row = lo + w.text[own]
                    yield pa.RecordBatch.from_arrays([pa.array(w.anchor_hash[at].view(np.int64)), _repeat(batch.column("id"), row), _repeat(batch.column("version"), row), pa.array((at - w.first[own]).astype(np.int32))], ["h", "id", "version", "pos"])

    return docs.select("id", "version", "text").mapInArrow(run, "h bigint, id bigint, version bigint, pos int")


def _suspect_windows(docs: DataFrame, width: int) -> DataFrame:
    """(w1, w2, id, version, pos): the windows of docs (id, version, text, at) whose anchor is one of the words `at`.

    Of equal windows in one piece of the input only the earliest keep their hashes w1 and w2: the others start later than they do, which is all
    there is to know of them. So a window that very many texts have is few rows to whoever brings equal windows together.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            at, ids = batch.column("at"), batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts, _CHUNK):
                w = _Windows(texts[lo:hi], width)
                if not len(w.start):
                    continue
                flagged = np.zeros(len(w.starts), bool)
                for k, i in enumerate(w.text.tolist()):
                    flagged[w.first[k] + np.asarray(at[lo + i].values)] = True
                s = w.start[flagged[w.anchor]]
                own = w.owner[s]
                row, pos = lo + w.text[own], s - w.first[own]
                w1, w2 = w.digest(s)
                order = np.lexsort((pos, ids[row], w2, w1))
                o1, o2, oi, op = w1[order], w2[order], ids[row][order], pos[order]
                first = np.flatnonzero(np.concatenate([[True], (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])])) if len(order) else order
                head = np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
                later = np.zeros(len(order), bool)
                later[order] = (oi != oi[head]) | (op != op[head])
                yield pa.RecordBatch.from_arrays([pa.array(w1, mask=later), pa.array(w2, mask=later), _repeat(batch.column("id"), row), _repeat(batch.column("version"), row), pa.array(pos.astype(np.int32))], ["w1", "w2", "id", "version", "pos"])

    return docs.select("id", "version", "text", "at").mapInArrow(run, "w1 bigint, w2 int, id bigint, version bigint, pos int")


_TEXT = "id bigint, version bigint, text string"


class FingerprintLog:
    """The index of all documents added so far, in ascending order of id from batch to batch, as tables under one folder.

    A run holds the anchors of some batches, sorted by hash; `texts` holds the batches' texts, dealt by document, of which later batches read
    those rows that share an anchor with them, without a shuffle. The list of tables is written anew, as a table itself, at the end of each batch:
    a batch that fails leaves the log as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, fanout: int = 2) -> None:
        self.spark, self.path, self.width, self.fanout = spark, path or f"{shared_dir(spark)}/log", width, fanout
        self.runs: list[tuple[int, str]] = []
        self.texts: list[tuple[str, int]] = []
        self.batches = 0

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintLog:
        """The log under this folder as of its last whole batch, in whatever session it was written."""
        rows = spark.read.schema("batch int, kind string, name string, n int, width int, fanout int").parquet(f"{path}/batches")
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last).collect()
        log = FingerprintLog(spark, path, rows[0].width, rows[0].fanout)
        log.batches = last
        log.runs = sorted((r.n, r.name) for r in rows if r.kind == "run")
        log.texts = sorted((r.name, r.n) for r in rows if r.kind == "texts")
        return log

    def _save(self) -> None:
        self.batches += 1
        rows = [(self.batches, "run", name, level, self.width, self.fanout) for level, name in self.runs] + [(self.batches, "texts", name, n, self.width, self.fanout) for name, n in self.texts]
        table = self.spark.createDataFrame(rows, "batch int, kind string, name string, n int, width int, fanout int")
        table.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema("h bigint, id bigint, version bigint, pos int").parquet(f"{self.path}/{name}")

    def _texts(self, name: str, n: int) -> DataFrame:
        return read_bucketed(self.spark, f"{self.path}/{name}", _TEXT, ["id", "version"], n)

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        written(rows.sortWithinPartitions("h"), f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, above: int | None = None) -> DataFrame:
        """Adds docs (id, version, text) to the index. Their ids are above those added before, of which `above` is the last.

        Returns (id, version, at): the words at which a window begins that also begins earlier, for each document with such windows. A hash
        that very many anchors have is no single task's: counts are combined before they are shuffled, and the join is with a written table, so that
        adaptive execution splits its large partitions; equal windows come as few rows (see `_suspect_windows`).
        """
        name = f"texts-{uuid.uuid4().hex}"
        own = bucketed(docs.select("id", "version", "text"), f"{self.path}/{name}", ["id", "version"])
        run = self._write_run(anchors(own, self.width))
        old = [self._run(x) for _, x in self.runs]
        self.texts.append((name, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        both = reduce(DataFrame.unionByName, [self._run(run).withColumn("new", F.lit(1)), *(x.withColumn("new", F.lit(0)) for x in old)])
        again = cut(both.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("h"), "again")
        suspects = cut(both.join(again.hint("merge"), "h", "left_semi").groupBy("id", "version").agg(F.collect_list("pos").alias("at")), "suspects")
        parts = [_suspect_windows(self._texts(x, n).join(suspects.hint("merge"), ["id", "version"]), self.width) for x, n in self.texts]
        windows = cut(reduce(DataFrame.unionByName, parts), "windows")
        same = Window.partitionBy("w1", "w2")
        earliest = windows.where("w1 is not null").withColumn("first", F.min(F.struct("id", "pos")).over(same)).where(F.struct("id", "pos") > F.col("first"))
        marked = earliest.select("id", "version", "pos").unionByName(windows.where("w1 is null").select("id", "version", "pos"))
        marked = marked if above is None else marked.where(F.col("id") > above)
        marks = cut(marked.groupBy("id", "version").agg(F.collect_list("pos").alias("at")), "marks")
        discard(again, suspects, windows)
        self.runs.append((0, run))
        self._compact()
        self._save()
        return marks

    def _compact(self) -> None:
        """Merges the runs of a level into one of the next as soon as there are `fanout` of them."""
        level = 0
        while sum(x == level for x, _ in self.runs) >= self.fanout:
            merged = reduce(DataFrame.unionByName, [self._run(r) for x, r in self.runs if x == level])
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.runs = [*((x, r) for x, r in self.runs if x != level), (level + 1, self._write_run(merged.repartitionByRange(n, "h", "id")))]
            level += 1


_NONE = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, version and text. Rows with a null id are judged as one document before all others; version, a hash of the text, tells rows of one id apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NONE)).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, batches: int = 2, fanout: int = 2) -> tuple[DataFrame, FingerprintLog]:
    """(id, version, at) as of FingerprintLog.add, over all docs, which are added in batches of ascending ids; and the log.

    Rows that share an id are copies of one document: windows at the same place of both are not repeats of one another.
    """
    keyed = _keyed(docs, id_col, text)
    bounds = keyed.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    log, parts, low = FingerprintLog(docs.sparkSession, None, width, fanout), [], None
    for high in [*sorted(set(bounds or [])), None]:
        part = keyed if low is None else keyed.where(F.col("id") > low)
        parts.append(log.add(part if high is None else part.where(F.col("id") <= high), low))
        low = high
    return reduce(DataFrame.unionByName, parts), log


def _kept(words: list[bytes], at: list[int], width: int) -> list[bytes]:
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.asarray(at, np.int64) + width, -1)
    covered = np.cumsum(step)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, batches: int = 2, fanout: int = 2) -> DataFrame:
    """id_col, n_words, n_removed and kept: the words that stay, joined by one blank.

    A null text has no words and keeps the empty text; repeated rows are each reported; further columns are not carried. The texts are read back
    from the log, where they lie dealt by document.
    """
    arrow_limits(docs.sparkSession)
    marks, log = repeated(docs, id_col, text, width, batches, fanout)
    kind = docs.schema[id_col].dataType.simpleString()
    marks = marks.hint("merge")
    both = reduce(DataFrame.unionByName, [log._texts(x, n).join(marks, ["id", "version"], "left") for x, n in log.texts])

    def run(batches_: Iterator[pa.RecordBatch]):
        for batch in batches_:
            n, removed, kept = [], [], []
            for x, at in zip(texts_of(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                words = x.split()
                rest = _kept(words, at, width) if at else words
                n.append(len(words))
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
            yield with_columns(batch, ["__own"], {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    own = F.when(F.col("id") != _NONE, F.col("id")).alias("__own")
    out = both.select(own, "text", "at").mapInArrow(run, "__own bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("__own").cast(kind).alias(id_col), "n_words", "n_removed", "kept")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return cleaned(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
