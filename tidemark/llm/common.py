"""Shared folders, Arrow batch handling and byte-level helpers for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Python workers see texts in pieces of about this size.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names no such folder (tests on one machine) a temporary one is set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Shuffle files of a finished write are of no more use; Spark deletes them when the write ends, and not only with the driver's next full collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation."""
    return written(df, f"{shared_dir(df.sparkSession)}/{name}", partition_by)


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Writes df to path and reads it back."""
    spark = df.sparkSession
    reset = _kept_shuffles(spark)
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    finally:
        reset()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `cut` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _kept_shuffles(spark: SparkSession):
    """Lets Spark delete a write's shuffle files when the write ends; returns what sets the session back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    return lambda: spark.conf.set(_CLEANUP, before)


def bucketed(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes df to path, dealt by a hash of the keys into one sorted file a bucket, and reads it back: joins on the keys don't shuffle it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, reset = f"tidemark_{uuid.uuid4().hex}", _kept_shuffles(spark)
    try:
        rows = df.repartition(n, *keys).sortWithinPartitions(*keys)
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    finally:
        reset()
    spark.sql(f"DROP TABLE {name}")  # the files stay
    out = read_bucketed(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), keys, n)
    out._written_to = path
    return out


def read_bucketed(spark: SparkSession, path: str, columns: str, keys: list[str], n: int) -> DataFrame:
    """What `bucketed` has written into n buckets, in this session or another."""
    name, by = f"tidemark_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` bytes each; one text is never divided."""
    lo = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(texts):
        yield lo, len(texts)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * step
            done, step = done + k, step * step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=8)
def _held_powers(n: int, base: int) -> np.ndarray:
    return _powers(n, base)


class RangeHash:
    """Hashes of byte ranges of one buffer: a polynomial modulo 2**64, so any range costs two lookups."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        n = len(data)
        room = 1 << max(16, n.bit_length())  # powers are kept for the next buffer
        powers = _held_powers if room <= 1 << 22 else _powers
        self._inv = powers(room, pow(base, -1, 1 << 64))
        self._sum = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(room, base)[:n], out=self._sum[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[hi] - self._sum[lo]) * self._inv[lo] + (hi - lo).astype(np.uint64))


def with_columns(batch: pa.RecordBatch, keep: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch and the added ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *added.values()], [*keep, *added])


def ddl(df: DataFrame, names: list[str]) -> str:
    """DDL of some columns of df."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{x}` {kinds[x]}" for x in names)
