"""Interval operators: speakers for transcript segments, texts of windows, speech from frame scores, gap merging.

Every sequence is cut into blocks or buckets of its time axis; windows and joins work on (recording, block), and only
one summary row a block meets the others of its recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import stripped


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much of [a0, a1] and [b0, b1] is common, at least 0."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The gap between [a0, a1] and [b0, b1], 0 if they meet."""
    return F.when(a1 < b0, b0 - a1).when(b1 < a0, a0 - b1).otherwise(F.lit(0.0))


#: Parts that a recording's rows are spread over to meet the one row of their recording; buckets of an interval, at most.
PARTS, MOST_BUCKETS = 32, 1_000_000


def with_recording(rows: DataFrame, recordings: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to one row a recording; a recording's rows are spread by ``spread``, its row goes to every part."""
    part = F.pmod(F.xxhash64(spread), F.lit(PARTS))
    copies = recordings.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", part.cast("int")).join(copies, ["rec_id", "_part"], how).drop("_part")


def _buckets(first: Column, last: Column) -> Column:
    """The buckets of an interval; one wrong bound must not make billions of rows."""
    sound = (last - first).between(0, MOST_BUCKETS)
    return F.when(sound, F.sequence(first, last)).otherwise(F.raise_error(F.lit("an interval spans too many buckets of time")).cast("array<bigint>"))


def _near_pairs(left: DataFrame, right: DataFrame, reach: float, bucket_s: float) -> DataFrame:
    """Pairs (l.*, r.*) of intervals of one recording that are at most ``reach`` apart, each pair once.

    Both sides are spread over buckets of time; a pair counts in the first bucket that both have.
    """
    of = lambda c: F.floor(c / F.lit(bucket_s)).cast("long")
    slack = reach + 1e-6
    l_first, r_first = of(F.col("l0")), of(F.col("r0") - slack)
    spread_l = left.withColumn("_lf", l_first).withColumn("_bucket", F.explode(_buckets(l_first, of(F.col("l1")))))
    spread_r = right.withColumn("_rf", r_first).withColumn("_bucket", F.explode(_buckets(r_first, of(F.col("r1") + slack))))
    return spread_l.join(spread_r, ["rec_id", "_bucket"]).where(F.col("_bucket") == F.greatest("_lf", "_rf")).drop("_bucket", "_lf", "_rf")


def attach_speakers(diar: DataFrame, asr: DataFrame, eps: float = 0.05, gap_tol: float = 0.30, bucket_s: float = 30.0) -> DataFrame:
    """A speaker for every transcript segment: rec_id, seg_idx, speaker, tier.

    Both sides have rec_id, seg_idx, start, end (seconds; exchanged bounds are put right for matching).  Tiers: 0 the
    recording has no diarization (speaker 0) or one speaker only; 1 segments that hold the midpoint within ``eps``, by the
    largest overlap with the segment widened by ``eps``; 2 the largest such overlap above 0; 3 the nearest segment, at
    most ``gap_tol`` away; 4 the first segment's speaker.  Ties go to the earlier start, then the smaller seg_idx.
    """
    left = asr.select("rec_id", F.col("seg_idx").alias("l_idx"), F.least("start", "end").alias("l0"), F.greatest("start", "end").alias("l1"))
    right = diar.select("rec_id", F.col("seg_idx").alias("r_idx"), F.least("start", "end").alias("r0"), F.greatest("start", "end").alias("r1"), "speaker")
    mid = F.lit(0.5) * (F.col("l0") + F.col("l1"))
    wide0, wide1 = F.col("r0") - eps, F.col("r1") + eps
    common, apart = overlap(F.col("l0"), F.col("l1"), wide0, wide1), distance(F.col("l0"), F.col("l1"), F.col("r0"), F.col("r1"))
    tier = F.when((wide0 <= mid) & (mid <= wide1), 1).when(common > 0, 2).when(apart <= gap_tol, 3)
    pairs = _near_pairs(left, right, max(eps, gap_tol), bucket_s).withColumn("tier", tier).where(F.col("tier").isNotNull())
    key = F.when(F.col("tier") <= 2, -common).otherwise(apart)
    best = pairs.groupBy("rec_id", "l_idx").agg(F.min(F.struct("tier", key.alias("key"), "r0", "r_idx", "speaker")).alias("best"))
    of_rec = right.groupBy("rec_id").agg(F.min("speaker").alias("_low"), F.max("speaker").alias("_high"), F.min(F.struct("r0", "r_idx", "speaker")).alias("_first"))
    rows = left.select("rec_id", "l_idx").join(best, ["rec_id", "l_idx"], "left")
    rows = with_recording(rows, of_rec, "l_idx", "left")
    none, single = F.col("_first").isNull(), F.col("_low") == F.col("_high")
    speaker = F.when(none, F.lit(0)).when(single, F.col("_low")).otherwise(F.coalesce("best.speaker", "_first.speaker")).cast("int")
    return rows.select("rec_id", F.col("l_idx").alias("seg_idx"), speaker.alias("speaker"), F.when(none | single, 0).otherwise(F.coalesce("best.tier", F.lit(4))).cast("int").alias("tier"))


def window_text(diar: DataFrame, asr: DataFrame, bucket_s: float = 30.0) -> DataFrame:
    """For every diarization segment the texts of all transcript segments that overlap it, in order: rec_id, seg_idx, text."""
    left = diar.select("rec_id", F.col("seg_idx").alias("l_idx"), F.col("start").alias("l0"), F.col("end").alias("l1"))
    right = asr.select("rec_id", F.col("seg_idx").alias("r_idx"), F.col("start").alias("r0"), F.col("end").alias("r1"), stripped(F.coalesce("text", F.lit(""))).alias("said"))
    right = right.where(F.col("said") != "")
    met = _near_pairs(left.where("l0 < l1"), right.where("r0 < r1"), 0.0, bucket_s).where((F.col("r0") < F.col("l1")) & (F.col("l0") < F.col("r1")))
    said = F.array_sort(F.collect_list(F.struct("r0", "r1", "r_idx", "said")))
    texts = met.groupBy("rec_id", "l_idx").agg(F.array_join(F.transform(said, lambda x: x["said"]), " ").alias("text"))
    return left.select("rec_id", "l_idx").join(texts, ["rec_id", "l_idx"], "left").select("rec_id", F.col("l_idx").alias("seg_idx"), F.coalesce("text", F.lit("")).alias("text"))


def hysteresis(frames: DataFrame, on: float = 0.55, off: float = 0.45, block: int = 60_000) -> DataFrame:
    """``frames`` (rec_id, frame_idx, p) with speech: on from ``on``, off below ``off``, held between; off at the start."""
    decisive = F.when(F.col("p") >= on, F.lit(True)).when(F.col("p") < off, F.lit(False))
    marked = frames.withColumn("_d", decisive).withColumn("_block", F.floor(F.col("frame_idx") / F.lit(block)).cast("long"))
    last = marked.groupBy("rec_id", "_block").agg(F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("frame_idx"))).alias("_last"))
    before = Window.partitionBy("rec_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("rec_id", "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    own = F.last("_d", ignorenulls=True).over(Window.partitionBy("rec_id", "_block").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    held = marked.withColumn("_own", own).join(carried, ["rec_id", "_block"])
    return held.withColumn("speech", F.coalesce("_own", "_carried", F.lit(False))).drop("_d", "_block", "_own", "_carried")


def merge_gaps(intervals: DataFrame, entity: list[str], gap: float | int, block: float | int) -> DataFrame:
    """Intervals (entity, start, end) merged where the next starts at most ``gap`` after the latest end so far.

    Result: entity, start, end, n.  Blocks are cut by start; what runs over from earlier blocks comes as one row a block.
    """
    cut = intervals.withColumn("_block", F.floor(F.col("start") / F.lit(block)).cast("long"))
    by = Window.partitionBy(*entity).orderBy("_block")
    ends = cut.groupBy(*entity, "_block").agg(F.max("end").alias("_end"))
    carried = ends.select(*entity, "_block", F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    at = Window.partitionBy(*entity, "_block").orderBy("start", "end")
    so_far = F.greatest(F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    flagged = cut.join(carried, [*entity, "_block"]).withColumn("_far", so_far)
    flagged = flagged.withColumn("_new", F.when(F.col("start") - F.col("_far") <= gap, 0).otherwise(1))
    numbered = flagged.withColumn("_own", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*entity, "_block", "_own").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    # A block's islands are numbered on from those of the blocks before it.
    counts = parts.groupBy(*entity, "_block").agg(F.max("_own").alias("_islands"))
    offsets = counts.select(*entity, "_block", F.coalesce(F.sum("_islands").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    whole = parts.join(offsets, [*entity, "_block"]).withColumn("_island", F.col("_offset") + F.col("_own"))
    return whole.groupBy(*entity, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def speech_runs(frames: DataFrame, min_silence_frames: int, min_speech_frames: int, block: int = 60_000) -> DataFrame:
    """Runs of speech frames (rec_id, frame_idx, speech) in frames: rec_id, start, end (exclusive).

    A pause shorter than ``min_silence_frames`` does not end a run; a run still open at the last frame reaches to its end.
    """
    least = max(min_silence_frames, 1)
    length = frames.groupBy("rec_id").agg((F.max("frame_idx") + 1).alias("_length"))
    spoken = frames.where("speech").select("rec_id", F.col("frame_idx").cast("long").alias("start"), (F.col("frame_idx") + 1).cast("long").alias("end"))
    found = with_recording(merge_gaps(spoken, ["rec_id"], least - 1, block), length, "start")
    end = F.when(F.col("_length") - F.col("end") < least, F.col("_length")).otherwise(F.col("end"))
    return found.select("rec_id", "start", end.cast("long").alias("end")).where(F.col("end") - F.col("start") >= max(1, min_speech_frames))


def padded(intervals: DataFrame, pad: float, total: Column | None = None) -> DataFrame:
    """Intervals widened by ``pad`` on both sides, not below 0 and not beyond ``total`` where it is known."""
    end = F.col("end") + pad
    return intervals.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - pad), "end": end if total is None else F.least(end, total)})


def speech_segments(
    frames: DataFrame, sec_per_frame: float, on: float = 0.55, off: float = 0.45, min_silence_ms: int = 140, min_speech_ms: int = 140, pad_ms: int = 100, merge_gap_ms: int = 140, block: int = 60_000
) -> DataFrame:
    """Speech segments in seconds from frame scores: threshold with hysteresis, runs, padding, gap merging, least length."""
    frame_count = lambda ms: round(ms / 1000.0 / sec_per_frame)
    speech = hysteresis(frames, on, off, block)
    found = speech_runs(speech, frame_count(min_silence_ms), frame_count(min_speech_ms), block)
    seconds = found.select("rec_id", (F.col("start") * F.lit(sec_per_frame)).alias("start"), (F.col("end") * F.lit(sec_per_frame)).alias("end"))
    total = frames.groupBy("rec_id").agg(((F.max("frame_idx") + 1) * F.lit(sec_per_frame)).alias("_total"))
    wide = padded(with_recording(seconds, total, "start"), pad_ms / 1000.0, F.col("_total")).drop("_total")
    merged = merge_gaps(wide, ["rec_id"], merge_gap_ms / 1000.0, block * sec_per_frame)
    return merged.where(F.col("end") - F.col("start") >= min_speech_ms / 1000.0).select("rec_id", "start", "end")


def normalized_segments(segments: DataFrame, merge_gap_ms: int = 140, min_speech_ms: int = 140, pad_ms: int = 100, total: Column | None = None, block_s: float = 600.0) -> DataFrame:
    """Segments (rec_id, start, end) padded, merged over short gaps, and those of the least length kept."""
    merged = merge_gaps(padded(segments, pad_ms / 1000.0, total), ["rec_id"], merge_gap_ms / 1000.0, block_s)
    return merged.where(F.col("end") - F.col("start") >= min_speech_ms / 1000.0).select("rec_id", "start", "end")


def speaker_numbers(segments: DataFrame) -> DataFrame:
    """rec_id, label, speaker: labels numbered from 0 by their first emission (``ord``)."""
    first = segments.where(F.col("label").isNotNull()).groupBy("rec_id", "label").agg(F.min("ord").alias("_first"))
    return first.select("rec_id", "label", (F.row_number().over(Window.partitionBy("rec_id").orderBy("_first", "label")) - 1).alias("speaker"))
