"""Problem 1: runs of consecutive events of one speaker, each as one event with its count and duration.

Each event is compared with its predecessor by a lag window, changes are flagged, the flags are summed to run
identifiers and the runs aggregated (``operators.islands`` does this in blocks of the time axis, so that a recording
without end is spread over tasks).

Defined results: events without recording, segment number, bound or speaker number take no part and don't interrupt;
rows delivered twice count once; equal starts are ordered by end, then seg_idx; an empty table gives no run; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.segments import bounded_segments
from turnwise.operators.islands import BLOCK_MS, runs


def speaker_runs(segments: DataFrame, least: int = 2, block_ms: int = BLOCK_MS) -> DataFrame:
    """Runs of ``least`` or more segments: rec_id, speaker, first_seg_idx, last_seg_idx, n_events, start_ms, end_ms, duration_ms."""
    known = bounded_segments(segments, "label").where(F.col("speaker_no").isNotNull())
    found = runs(known, ["rec_id"], "speaker_no", ["start_ms", "end_ms", "seg_idx"], block_ms).where(F.col("n") >= least)
    return found.select(
        "rec_id",
        F.col("speaker_no").alias("speaker"),
        F.col("first.seg_idx").alias("first_seg_idx"),
        F.col("last.seg_idx").alias("last_seg_idx"),
        F.col("n").alias("n_events"),
        F.col("first.start_ms").alias("start_ms"),
        F.col("until").alias("end_ms"),
        (F.col("until") - F.col("first.start_ms")).alias("duration_ms"),
    )
