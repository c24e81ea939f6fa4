"""The driver's tables, and activities made from the event stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(events: DataFrame) -> DataFrame:
    """id, user_id, app, title, start_ms, end_ms: an activity lasts as many seconds as its event's value says.

    Epoch milliseconds are counted from the wall clock of the event, whatever the session's time zone.
    """
    start = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000).cast("bigint")
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("app"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("title"),
        start.alias("start_ms"), (start + F.round(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)) * 1000).cast("bigint")).alias("end_ms"),
    )


def _checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where the session names none, a temporary one is set on a local master; on a
    cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: lineage ends, and a lost executor costs no recomputation."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like `kept`, as a Parquet table: for loops, in which neither plans, nor what Spark infers about them, nor the tasks of small tables grow."""
    path = f"{_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
