"""Queries of the interval and dialogue operators, with SQL for each that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions.segments import bounded_segments, one_per_segment, speaker_number
from turnwise.functions.text import speaker_index, srt_time, stripped, word_count
from turnwise.operators import intervals, turns
from turnwise.sources.files import manifests, segments_json
from turnwise.sources.tables import table, written

Q = DataFrame


def _seconds(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    """Segments of a table with both bounds, one row each: rec_id, seg_idx, start, end, speaker, ``more``."""
    df = table(spark, sf_dir, name)
    speaker = F.col("speaker").cast("int") if name.startswith("diar") else speaker_number(F.col("speaker"))
    slim = df.select("rec_id", "seg_idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), speaker.alias("speaker"), *more, "arrived_at")
    finite = (F.abs("start") < 9e14) & (F.abs("end") < 9e14)
    return one_per_segment(slim, ["start", "end", "speaker", *more]).where(finite & ~F.isnan("start") & ~F.isnan("end"))


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments in milliseconds with known speakers and texts."""
    df = bounded_segments(table(spark, sf_dir, "asr_segments"), "label", ("text",))
    return df.where(F.col("speaker_no").isNotNull()).withColumnRenamed("speaker_no", "speaker")


def dialogue_turns(spark: SparkSession, sf_dir: str) -> Q:
    return turns.dialogue_turns(_labeled(spark, sf_dir))


def dialogue_files(spark: SparkSession, sf_dir: str) -> Q:
    return turns.dialogue_lines(turns.dialogue_turns(_labeled(spark, sf_dir)))


def speaker_paragraphs(spark: SparkSession, sf_dir: str) -> Q:
    return turns.speaker_paragraphs(_labeled(spark, sf_dir), cleaned=False)


def speaker_paragraphs_clean(spark: SparkSession, sf_dir: str) -> Q:
    rows = turns.speaker_paragraphs(_labeled(spark, sf_dir))
    return rows.select("rec_id", "speaker", turns.paragraph_block(F.col("speaker"), F.col("text")).alias("block"))


def attach_speakers(spark: SparkSession, sf_dir: str) -> Q:
    diar = _seconds(spark, sf_dir, "diar_segments").where(F.col("speaker").isNotNull())
    return intervals.attach_speakers(diar, _seconds(spark, sf_dir, "asr_segments"))


def window_text(spark: SparkSession, sf_dir: str) -> Q:
    return intervals.window_text(_seconds(spark, sf_dir, "diar_segments"), _seconds(spark, sf_dir, "asr_segments", "text"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame scores: each user's values in order of time, numbered by days with the days' offsets."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "event_id", F.col("value").alias("p"), F.to_date("ts").alias("day"))
    sizes = events.groupBy("rec_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rec_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("rec_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("rec_id", "day").orderBy("ts", "event_id")) - 1
    return events.withColumn("own", own).join(offsets, ["rec_id", "day"]).select("rec_id", (F.col("offset") + F.col("own")).cast("long").alias("frame_idx"), "p")


def vad_hysteresis(spark: SparkSession, sf_dir: str) -> Q:
    return intervals.hysteresis(_frames(spark, sf_dir), 55.0, 45.0, 64).select("rec_id", "frame_idx", "speech")


def vad_segments(spark: SparkSession, sf_dir: str) -> Q:
    found = intervals.speech_segments(written(_frames(spark, sf_dir), "frames"), 0.125, 55.0, 45.0, 250, 250, 125, 250, 64)
    return found.select("rec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def gap_merge(spark: SparkSession, sf_dir: str) -> Q:
    diar = bounded_segments(table(spark, sf_dir, "diar_segments"), "number").where(F.col("speaker_no").isNotNull())
    rows = diar.select("rec_id", F.col("speaker_no").alias("speaker"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    merged = intervals.merge_gaps(rows, ["rec_id", "speaker"], 140, 600_000)
    return merged.where(F.col("end") - F.col("start") >= 140).select("rec_id", "speaker", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


def srt_cues(spark: SparkSession, sf_dir: str) -> Q:
    return turns.srt_cues(_seconds(spark, sf_dir, "asr_segments", "text").where(F.col("speaker").isNotNull()))


def srt_times(spark: SparkSession, sf_dir: str) -> Q:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 3).alias("seconds")).distinct()
    return lines.select(F.round("seconds", 6).alias("seconds"), srt_time(F.col("seconds")).alias("srt"))


def speaker_ids(spark: SparkSession, sf_dir: str) -> Q:
    asr = table(spark, sf_dir, "asr_segments").select("rec_id", F.lower(F.trim("speaker")).alias("label"), F.col("seg_idx").alias("ord"))
    return intervals.speaker_numbers(asr).select("rec_id", "label", F.col("speaker").cast("long").alias("speaker"))


def speaker_indices(spark: SparkSession, sf_dir: str) -> Q:
    labels = table(spark, sf_dir, "asr_segments").groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("speaker", speaker_index(F.col("speaker")).alias("idx"), "n")


def text_counts(spark: SparkSession, sf_dir: str) -> Q:
    asr = table(spark, sf_dir, "asr_segments")
    return asr.groupBy("rec_id").agg(F.sum(word_count(F.col("text")).cast("long")).alias("n_words"), F.sum(F.length(stripped(F.coalesce("text", F.lit("")))).cast("long")).alias("n_chars"))


def run_manifests(spark: SparkSession, sf_dir: str) -> Q:
    return manifests(table(spark, sf_dir, "recordings"))


def segment_files(spark: SparkSession, sf_dir: str) -> Q:
    """The segments of each recording as JSON, with the run's own audio, device and number of speakers."""
    segments = _seconds(spark, sf_dir, "asr_segments", "text").where(F.col("speaker").isNotNull())
    runs = table(spark, sf_dir, "recordings").where(F.col("rec_id").isNotNull())
    latest = runs.groupBy("rec_id").agg(F.max(F.struct(F.coalesce("updated_at", "created_at"), "audio", "device", "n_speakers")).alias("r")).select("rec_id", "r.audio", "r.device", "r.n_speakers")
    rows = segments_json(segments, latest)
    return rows.select("rec_id", F.get_json_object("json", "$.n_speakers").cast("int").alias("n_speakers"), F.size(F.from_json("json", "segments array<struct<start:double,end:double,start_s:double,end_s:double>>")["segments"]).alias("n_segments"), F.get_json_object("json", "$.segments[0].start_s").cast("double").alias("first_start"))


def report_blocks(spark: SparkSession, sf_dir: str) -> Q:
    """Documents as a report's headings and paragraphs."""
    return turns.report_blocks(table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "(?m)^([A-Z][^\\n.]{2,40})$", "### $1").alias("text")))


QUERIES = {
    f.__name__: f
    for f in (
        dialogue_turns, dialogue_files, speaker_paragraphs, speaker_paragraphs_clean, attach_speakers, window_text, vad_hysteresis, vad_segments, gap_merge, srt_cues, srt_times, speaker_ids,
        speaker_indices, text_counts, run_manifests, segment_files, report_blocks,
    )
}

#: Blank space of any kind, for expressions that only know its ASCII part.
_S = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ONE = "row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY arrived_at, start_s, end_s)"
_LABEL = "TRY_CAST(nullif(regexp_extract(speaker, '([0-9]+)', 1), '') AS INTEGER)"
_STRIP = lambda c: f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"
_ASR = f"""asr AS (
  SELECT rec_id, seg_idx, start_s AS s, end_s AS e, {_LABEL} AS speaker, text FROM (SELECT *, {_ONE} AS n FROM asr_segments WHERE rec_id IS NOT NULL AND seg_idx IS NOT NULL)
  WHERE n = 1 AND start_s IS NOT NULL AND end_s IS NOT NULL)"""
_DIAR = f"""diar AS (
  SELECT rec_id, seg_idx, start_s AS s, end_s AS e, speaker FROM (SELECT *, {_ONE} AS n FROM diar_segments WHERE rec_id IS NOT NULL AND seg_idx IS NOT NULL)
  WHERE n = 1 AND start_s IS NOT NULL AND end_s IS NOT NULL)"""
_MS = """ms AS (
  SELECT rec_id, seg_idx, speaker, text, CAST(round_even(least(s, e) * 1000.0, 0) AS BIGINT) AS s, CAST(round_even(greatest(s, e) * 1000.0, 0) AS BIGINT) AS e FROM asr WHERE speaker IS NOT NULL)"""
_TURNS = f"""WITH {_ASR}, {_MS},
spoken AS (SELECT *, {_STRIP("text")} AS said FROM ms WHERE {_STRIP("text")} <> ''),
flagged AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY rec_id ORDER BY s, e, seg_idx) THEN 0 ELSE 1 END AS f FROM spoken),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY s, e, seg_idx) AS run FROM flagged),
joined AS (SELECT rec_id, run, any_value(speaker) AS speaker, min(s) AS turn_start, count(*) AS n, string_agg(said, ' ' ORDER BY s, e, seg_idx) AS t FROM numbered GROUP BY rec_id, run),
turn AS (
  SELECT rec_id, turn_start, speaker + 1 AS speaker, n,
    {_STRIP(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_S}+', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g'), '([,.;:!?])', '\\1 ', 'g'), ' +', ' ', 'g')")} AS text FROM joined)"""
_TIME = lambda c: (
    f"(lpad(CAST(CAST(round_even({c} * 1000.0, 0) AS BIGINT) // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(CAST(round_even({c} * 1000.0, 0) AS BIGINT) // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || "
    f"lpad(CAST((CAST(round_even({c} * 1000.0, 0) AS BIGINT) // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((CAST(round_even({c} * 1000.0, 0) AS BIGINT) // 1000) % 60 AS VARCHAR), 2, '0') || ',' || "
    f"lpad(CAST(CAST(round_even({c} * 1000.0, 0) AS BIGINT) % 1000 AS VARCHAR), 3, '0'))"
)
_FRAMES = """frames AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS p FROM events),
held AS (SELECT rec_id, i, coalesce(last_value(CASE WHEN p >= 55 THEN true WHEN p < 45 THEN false END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS speech FROM frames)"""

SQL = {
    "dialogue_turns": f"{_TURNS} SELECT rec_id, turn_start, speaker, n, text FROM turn",
    "dialogue_files": f"{_TURNS} SELECT rec_id, string_agg('SPEAKER_' || speaker || ' : ' || text, chr(10) ORDER BY turn_start, speaker) AS dialogue FROM turn GROUP BY rec_id",
    "speaker_paragraphs": f"""WITH {_ASR}, {_MS}
SELECT rec_id, speaker, min(s) AS first_start, trim(string_agg(trim(regexp_replace({_STRIP("text")}, '{_S}+', ' ', 'g')), ' ' ORDER BY s, e, seg_idx)) AS text
FROM ms WHERE {_STRIP("coalesce(text, '')")} <> '' GROUP BY rec_id, speaker""",
    "attach_speakers": f"""WITH {_ASR}, {_DIAR},
a AS (SELECT rec_id, seg_idx, least(s, e) AS a0, greatest(s, e) AS a1 FROM asr),
d AS (SELECT rec_id, seg_idx, least(s, e) AS d0, greatest(s, e) AS d1, speaker FROM diar WHERE speaker IS NOT NULL),
pairs AS (
  SELECT a.rec_id, a.seg_idx, d.speaker, d0, d.seg_idx AS d_idx, 0.5 * (a0 + a1) AS mid, d0 - 0.05 AS w0, d1 + 0.05 AS w1,
    greatest(0.0, least(a1, d1 + 0.05) - greatest(a0, d0 - 0.05)) AS ov, CASE WHEN a1 < d0 THEN d0 - a1 WHEN d1 < a0 THEN a0 - d1 ELSE 0.0 END AS dist
  FROM a JOIN d ON a.rec_id = d.rec_id AND d0 <= a1 + 1 AND d1 >= a0 - 1),
tiers AS (SELECT *, CASE WHEN w0 <= mid AND mid <= w1 THEN 1 WHEN ov > 0 THEN 2 WHEN dist <= 0.30 THEN 3 END AS tier FROM pairs),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY tier, CASE WHEN tier <= 2 THEN -ov ELSE dist END, d0, d_idx) AS n FROM tiers WHERE tier IS NOT NULL) WHERE n = 1),
recs AS (SELECT rec_id, min(speaker) AS low, max(speaker) AS high, arg_min(speaker, (d0, seg_idx)) AS first FROM d GROUP BY rec_id)
SELECT a.rec_id, a.seg_idx, CAST(CASE WHEN r.rec_id IS NULL THEN 0 WHEN low = high THEN low ELSE coalesce(b.speaker, first) END AS INTEGER) AS speaker,
  CAST(CASE WHEN r.rec_id IS NULL OR low = high THEN 0 ELSE coalesce(b.tier, 4) END AS INTEGER) AS tier
FROM a LEFT JOIN best b ON a.rec_id = b.rec_id AND a.seg_idx = b.seg_idx LEFT JOIN recs r ON a.rec_id = r.rec_id""",
    "window_text": f"""WITH {_ASR}, {_DIAR},
said AS (SELECT rec_id, seg_idx, s, e, {_STRIP("text")} AS t FROM asr WHERE {_STRIP("coalesce(text, '')")} <> '')
SELECT d.rec_id, d.seg_idx, coalesce(string_agg(t, ' ' ORDER BY a.s, a.e, a.seg_idx), '') AS text
FROM diar d LEFT JOIN said a ON a.rec_id = d.rec_id AND a.s < d.e AND d.s < a.e AND d.s < d.e AND a.s < a.e GROUP BY d.rec_id, d.seg_idx""",
    "vad_hysteresis": f"WITH {_FRAMES} SELECT rec_id, i AS frame_idx, speech FROM held",
    "vad_segments": f"""WITH {_FRAMES},
len AS (SELECT rec_id, count(*) AS t FROM frames GROUP BY rec_id),
f AS (SELECT rec_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY rec_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS f FROM held WHERE speech),
r AS (SELECT rec_id, i, sum(f) OVER (PARTITION BY rec_id ORDER BY i) AS run FROM f),
runs AS (SELECT r.rec_id, min(i) AS a, CASE WHEN any_value(t) - 1 - max(i) < 2 THEN any_value(t) ELSE max(i) + 1 END AS b, any_value(t) AS t FROM r JOIN len USING (rec_id) GROUP BY r.rec_id, run),
wide AS (SELECT rec_id, greatest(0.0, a * 0.125 - 0.125) AS s, least(b * 0.125 + 0.125, t * 0.125) AS e FROM runs WHERE b - a >= 2),
n AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.25 THEN 0 ELSE 1 END AS f FROM wide),
g AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY s, e) AS run FROM n)
SELECT rec_id, round(CAST(min(s) AS DOUBLE), 6) AS start, round(CAST(max(e) AS DOUBLE), 6) AS "end" FROM g GROUP BY rec_id, run HAVING max(e) - min(s) >= 0.25""",
    "gap_merge": f"""WITH {_DIAR},
seg AS (SELECT rec_id, speaker, seg_idx, CAST(round_even(least(s, e) * 1000.0, 0) AS BIGINT) AS s, CAST(round_even(greatest(s, e) * 1000.0, 0) AS BIGINT) AS e FROM diar WHERE speaker IS NOT NULL),
n AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec_id, speaker ORDER BY s, e, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 140 THEN 0 ELSE 1 END AS f FROM seg),
g AS (SELECT *, sum(f) OVER (PARTITION BY rec_id, speaker ORDER BY s, e, seg_idx) AS run FROM n)
SELECT rec_id, speaker, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n FROM g GROUP BY rec_id, speaker, run HAVING max(e) - min(s) >= 140""",
    "srt_cues": f"""WITH {_ASR},
n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s, e, seg_idx) AS cue, {_STRIP("coalesce(text, '')")} AS said FROM asr WHERE speaker IS NOT NULL)
SELECT rec_id, cue, cue || chr(10) || {_TIME("s")} || ' --> ' || {_TIME("e")} || chr(10) || 'SPK' || speaker || CASE WHEN said <> '' THEN ': ' || said ELSE '' END || chr(10) AS block FROM n""",
    "srt_times": f"WITH x AS (SELECT DISTINCT l_extendedprice / 3 AS seconds FROM lineitem) SELECT round(seconds, 6) AS seconds, {_TIME('seconds')} AS srt FROM x",
    "speaker_ids": """WITH first AS (SELECT rec_id, lower(trim(speaker)) AS label, min(seg_idx) AS f FROM asr_segments WHERE speaker IS NOT NULL GROUP BY 1, 2)
SELECT rec_id, label, row_number() OVER (PARTITION BY rec_id ORDER BY f, label) - 1 AS speaker FROM first""",
    "speaker_indices": """SELECT speaker, coalesce(TRY_CAST(nullif(trim(replace(replace(upper(speaker), 'SPEAKER_', ''), 'SPK', '')), '') AS INTEGER), 0) AS idx, count(*) AS n FROM asr_segments GROUP BY speaker""",
    "text_counts": f"""SELECT rec_id, CAST(sum(CASE WHEN {_STRIP("coalesce(text, '')")} = '' THEN 0 ELSE len(string_split_regex({_STRIP("coalesce(text, '')")}, '{_S}+')) END) AS BIGINT) AS n_words,
  CAST(sum(length({_STRIP("coalesce(text, '')")})) AS BIGINT) AS n_chars FROM asr_segments GROUP BY rec_id""",
    "segment_files": f"""WITH {_ASR}, r AS (SELECT rec_id, arg_max(n_speakers, (coalesce(updated_at, created_at), audio, device, n_speakers)) AS k FROM recordings WHERE rec_id IS NOT NULL GROUP BY 1),
n AS (SELECT rec_id, count(*) AS c, arg_min(s, (s, e, seg_idx)) AS f FROM asr WHERE speaker IS NOT NULL GROUP BY 1)
SELECT n.rec_id, k AS n_speakers, CAST(c AS INTEGER) AS n_segments, f AS first_start FROM n LEFT JOIN r ON n.rec_id = r.rec_id""",
    "run_manifests": """WITH r AS (SELECT *, nullif(lower(trim(user_folder)), '') AS folder, nullif(lower(trim(device)), '') AS dev, nullif(lower(trim(lang)), '') AS lg, coalesce(updated_at, created_at) AS u FROM recordings WHERE rec_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY u DESC NULLS LAST, audio DESC NULLS LAST) AS k, min(created_at) OVER (PARTITION BY rec_id) AS c, count(*) OVER (PARTITION BY rec_id) AS n_runs FROM r)
SELECT rec_id, 1 AS schema_version, CASE WHEN lower(trim(run_state)) = 'ready' THEN 'ready' ELSE 'failed' END AS status, audio,
  coalesce(folder, CASE WHEN contains(audio, '/') THEN split_part(audio, '/', 1) END, '') AS user_folder, dev AS device, lg AS lang, c AS created_at, u AS updated_at, n_runs FROM b WHERE k = 1""",
}
