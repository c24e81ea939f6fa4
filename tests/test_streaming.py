"""Sessions: a stream in append mode gives what a batch gives, with shuffled files and events that are late within the watermark; later ones are dropped."""

import random

from pyspark.sql import functions as F

from tidemark.streaming.sessions import event_windows


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("app"))
    rows = sorted(map(tuple, events.collect()), key=lambda r: r[1])
    r = random.Random(8)
    late = sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(0, 40_000))
    size, last = -(-len(late) // 5), rows[-1][1]
    src = tmp_path / "in"
    for k in range(5):
        spark.createDataFrame(late[k * size : (k + 1) * size], events.schema).coalesce(1).write.parquet(str(src / f"a{k}"))
    # the first of these lets the watermark pass all that came before; the second is later than it, and dropped
    spark.createDataFrame([(-1, last.replace(year=last.year + 1), "x")], events.schema).coalesce(1).write.parquet(str(src / "b"))
    spark.createDataFrame([(-2, rows[0][1], "x"), (-1, last.replace(year=last.year + 2), "x")], events.schema).coalesce(1).write.parquet(str(src / "c"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = event_windows(source, "30 minutes", "12 hours").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got, want = spark.table("sessions"), event_windows(events, "30 minutes")
    assert sorted(map(tuple, got.where("user_id >= 0").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("user_id = -2").count() == 0
