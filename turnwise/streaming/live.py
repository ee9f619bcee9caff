"""Live forms of two operators over streams of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(segments: DataFrame, gap_ms: int = 140, late: str = "10 seconds") -> DataFrame:
    """Speech sessions of each (rec_id, speaker): ``segments`` is a stream with start_ts and end_ts.

    A session takes in what begins less than ``gap_ms`` after the latest end; segments later than ``late`` are dropped.
    """
    open_for = F.concat((F.unix_millis("end_ts") - F.unix_millis("start_ts") + gap_ms).cast("string"), F.lit(" milliseconds"))
    timed = segments.withWatermark("start_ts", late)
    return timed.groupBy("rec_id", "speaker", F.session_window("start_ts", open_for)).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


def live_counts(segments: DataFrame, window: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Segments and speakers heard in each window of each recording."""
    timed = segments.withWatermark("start_ts", late)
    grouped = timed.groupBy("rec_id", F.window("start_ts", window))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("speaker").alias("n_speakers")).select("rec_id", F.col("window.start").alias("window_start"), "n", "n_speakers")
