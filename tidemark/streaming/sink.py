"""Tables that streams append to, each id once whatever is replayed, and exports of what is new since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_once(batch: DataFrame, path: str, id_col: str = "id", time_col: str = "start_ms") -> None:
    """A foreachBatch sink: rows whose id isn't in the table yet, into a folder for each day of their time.

    Of rows with one id in a batch one stays. An id's time must not change: only the days of the batch are read. Rows without an id or a time
    are left out. A batch that fails and is run again adds what is missing, since it looks at the files that are there.
    """
    spark = batch.sparkSession
    rows = batch.where(F.col(id_col).isNotNull() & F.col(time_col).isNotNull()).dropDuplicates([id_col]).withColumn("day", F.floor(F.col(time_col) / DAY_MS).cast("bigint"))
    days = rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if days["lo"] is None:
        return
    if _there(spark, path):
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("day").between(days["lo"], days["hi"])).select(id_col)
        rows = rows.join(old, id_col, "left_anti")
    rows.write.mode("append").partitionBy("day").parquet(path)


def stored_mark(spark: SparkSession, path: str) -> int | None:
    """The mark of the latest export, None before the first. Marks only grow."""
    return spark.read.schema("mark long").json(path).agg(F.max("mark")).first()[0] if _there(spark, path) else None


def export_delta(rows: DataFrame, target: str, time_col: str = "end_ms", overlap_ms: int = 3_600_000) -> DataFrame | None:
    """Writes the rows whose time is at most overlap_ms before the stored mark, or later, as compressed JSON lines below target, and then stores the largest time as the mark.

    Returns what was written, None if nothing is new since. The folder bears the mark it began from, so a run that failed in between is done
    again in its place. Filters reach the scan of rows.
    """
    spark, marks = rows.sparkSession, f"{target}/marks"
    mark = stored_mark(spark, marks)
    fresh = rows if mark is None else rows.where(F.col(time_col) >= mark - overlap_ms)
    new = fresh.agg(F.max(time_col)).first()[0]
    if new is None or (mark is not None and new <= mark):
        return None
    out = f"{target}/delta/from={'start' if mark is None else mark}"
    fresh.where(F.col(time_col) <= new).write.mode("overwrite").option("compression", "gzip").json(out)
    spark.createDataFrame([(int(new),)], "mark long").coalesce(1).write.mode("append").json(marks)
    return spark.read.schema(rows.schema).json(out)
