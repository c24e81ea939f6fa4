"""Frames with the windows that hold them, when both are streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames_in_windows(frames: DataFrame, windows: DataFrame, key: str, longest: str, settle: str = "750 milliseconds", late: str = "5 seconds") -> DataFrame:
    """(key, id, ts, window, start_ts, end_ts): frames (key, id, ts) and windows (key, window, start_ts, end_ts) whose time holds them, both ends inclusive.

    Frames may be so late as `settle`, and windows as `late`; later ones are dropped. No window may last longer than `longest`; so a frame is
    kept until no window that could hold it may come, and a window until the frames up to its end have.
    """
    f = frames.select(F.col(key).alias("__key"), "id", "ts").withWatermark("ts", settle)
    w = windows.select(key, "window", "start_ts", "end_ts").withWatermark("end_ts", late)
    held = (F.col("__key") == F.col(key)) & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts")) & (F.col("ts") >= F.col("end_ts") - F.expr(f"INTERVAL {longest}"))
    return w.join(f, held).select(key, "id", "ts", "window", "start_ts", "end_ts")
