"""Dialogue operators: turns, paragraphs of each speaker, subtitle cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import clean_text, dialogue_spacing, normalize_ws, srt_time, stripped
from turnwise.operators.islands import BLOCK_MS, runs


def dialogue_turns(segments: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Neighbouring segments of one speaker as one turn: rec_id, turn_start, speaker (from 1), n, text.

    ``segments``: rec_id, seg_idx, start_ms, end_ms, speaker, text.  Blank texts are dropped before turns are sought, so
    they interrupt none.
    """
    spoken = segments.where(F.col("text").rlike(r"(?U)\S")).withColumn("said", stripped(F.col("text")))
    turns = runs(spoken, ["rec_id"], "speaker", ["start_ms", "end_ms", "seg_idx"], block_ms, text="said")
    return turns.select("rec_id", F.col("first.start_ms").alias("turn_start"), (F.col("speaker") + 1).alias("speaker"), F.col("n").alias("n"), dialogue_spacing(F.array_join("texts", " ")).alias("text"))


def dialogue_lines(turns: DataFrame) -> DataFrame:
    """rec_id, dialogue: one line ``SPEAKER_n : text`` for each turn, in order."""
    line = F.concat(F.lit("SPEAKER_"), F.col("speaker"), F.lit(" : "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn_start", "speaker", line.alias("line"))))
    return turns.groupBy("rec_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("dialogue"))


def speaker_paragraphs(segments: DataFrame, single: bool = False, least_chars: int = 1, cleaned: bool = True) -> DataFrame:
    """All that each speaker says as one paragraph: rec_id, speaker, first_start, text.

    With ``cleaned`` each piece and the whole are cleaned (stutter, punctuation, capitals), else only blanks are.
    """
    said = stripped(F.coalesce("text", F.lit("")))
    tidy = clean_text if cleaned else normalize_ws
    speaker = F.lit(0) if single else F.coalesce("speaker", F.lit(0))
    pieces = segments.where(F.length(said) >= least_chars).select("rec_id", speaker.alias("speaker"), "start_ms", "end_ms", "seg_idx", tidy(said).alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seg_idx", "said")))
    by = pieces.groupBy("rec_id", "speaker").agg(F.min("start_ms").alias("first_start"), F.array_join(F.transform(ordered, lambda x: x["said"]), " ").alias("text"))
    return by.withColumn("text", tidy(F.col("text")))


def paragraph_block(speaker: Column, text: Column, title: bool = False) -> Column:
    """A speaker's paragraph under its header, speakers counted from 1."""
    return F.concat(F.lit("SPEAKER_"), speaker + 1, F.lit("\n" if title else ": "), text, F.lit("\n"))


def srt_cues(segments: DataFrame) -> DataFrame:
    """Subtitle cues: rec_id, cue (from 1), block of lines.

    ``segments``: rec_id, seg_idx, start, end (seconds), speaker, text.  The numbers need one order of a recording's
    segments; they are counted in blocks of the time axis and offset by one row a block.
    """
    cut = segments.withColumn("_block", F.floor(F.col("start") / F.lit(600.0)).cast("long"))
    sizes = cut.groupBy("rec_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("rec_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("rec_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("rec_id", "_block").orderBy("start", "end", "seg_idx"))
    cue = (F.col("_offset") + F.col("_own")).cast("long")
    said = stripped(F.coalesce("text", F.lit("")))
    who = F.concat(F.lit("SPK"), F.col("speaker"))
    line = F.when(F.length(said) > 0, F.concat(who, F.lit(": "), said)).otherwise(who)
    times = F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")))
    numbered = cut.withColumn("_own", own).join(offsets, ["rec_id", "_block"])
    return numbered.select("rec_id", cue.alias("cue"), F.concat_ws("\n", cue, times, line, F.lit("")).alias("block"))


def report_blocks(docs: DataFrame) -> DataFrame:
    """A Markdown text's blocks: doc_id, block (from 1), kind, text.

    A line that starts with ``### `` is a heading; neighbouring other lines are one paragraph, which blank lines end.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).withColumn("line", stripped(F.col("line")))
    heading, blank = F.col("line").startswith("### "), F.col("line") == ""
    at = Window.partitionBy("doc_id").orderBy("no")
    starts = heading | (~blank & (F.coalesce(F.lag(heading | blank).over(at), F.lit(True))))
    numbered = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ")
    whole = numbered.groupBy("doc_id", "block").agg(said.alias("text"))
    is_heading = F.col("text").startswith("### ")
    return whole.select("doc_id", F.col("block").cast("int").alias("block"), F.when(is_heading, "heading").otherwise("paragraph").alias("kind"), F.when(is_heading, stripped(F.expr("substring(text, 5)"))).otherwise(F.col("text")).alias("text"))
