"""Columns of time-stamped segments: whole milliseconds, ordered bounds, speaker numbers, one row per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds (ties to even); null, NaN and infinite values give null."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e14))
    return F.when(finite, F.rint(seconds * F.lit(1000.0)).cast("long"))


def bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds in milliseconds, exchanged where the end lies before the start; both null if either is missing."""
    s, e = millis(start), millis(end)
    both = s.isNotNull() & e.isNotNull()
    return F.when(both, F.least(s, e)), F.when(both, F.greatest(s, e))


def speaker_number(label: Column) -> Column:
    """The (first) number in a speaker label, however it is written; null without one or beyond the int range."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.when(F.length(digits) > 0, digits.try_cast("int"))


def one_per_segment(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each (rec_id, seg_idx), with ``columns``.

    Of rows that a table holds several times, the one that arrived first stands (a null ``arrived_at`` comes last, then
    the smallest values decide).  Rows without rec_id or seg_idx can't be told apart as segments and are left out.  The
    shuffle is by segment, so a recording that holds a third of all rows is spread, and copies are reduced before it.
    """
    late = F.coalesce(F.col("arrived_at"), F.lit("9999-12-31").cast("timestamp_ntz")) if "arrived_at" in df.columns else F.lit(0)
    row = F.struct(late.alias("_late"), *columns)
    kept = df.where(F.col("rec_id").isNotNull() & F.col("seg_idx").isNotNull())
    return kept.groupBy("rec_id", "seg_idx").agg(F.min(row).alias("_row")).select("rec_id", "seg_idx", *[F.col(f"_row.{c}").alias(c) for c in columns])


def bounded_segments(df: DataFrame, speaker: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Segments with both bounds: rec_id, seg_idx, start_ms, end_ms, optionally ``speaker`` as int, and ``keep``.

    ``speaker`` is "number" (taken as it is) or "label" (its number is read).
    """
    s, e = bounds(F.col("start_s"), F.col("end_s"))
    cols = [s.alias("start_ms"), e.alias("end_ms")]
    names = ["start_ms", "end_ms"]
    if speaker:
        cols.append((F.col("speaker").cast("int") if speaker == "number" else speaker_number(F.col("speaker"))).alias("speaker_no"))
        names.append("speaker_no")
    arrived = [F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at")] if "arrived_at" in df.columns else []
    slim = df.select("rec_id", "seg_idx", *cols, *keep, *arrived)
    return one_per_segment(slim, names + list(keep)).where(F.col("start_ms").isNotNull())
