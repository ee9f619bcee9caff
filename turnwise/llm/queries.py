"""The queries of the problems for language data, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import abuse, byte_pairs, event_runs, leaks, nearest_time, personal_data, plain_text, speaker_turns
from turnwise.sources.tables import scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs.speaker_runs(table(spark, sf_dir, "asr_segments")).select("rec_id", "first_seg_idx", "last_seg_idx")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs.speaker_runs(table(spark, sf_dir, "asr_segments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_text.same_reading(table(spark, sf_dir, "asr_segments"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asr, diar = (nearest_time.table_stream(table(spark, sf_dir, t), f"{sf_dir}/{t}.parquet") for t in ("asr_segments", "diar_segments"))
    return nearest_time.nearest_diarization(asr, diar, scratch(spark, "ending")).select("rec_id", "asr_seg_idx", "diar_seg_idx")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns.speaker_turns(table(spark, sf_dir, "asr_segments")).select("rec_id", "speaker", "first_seg_idx", "last_seg_idx").distinct()


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns.canonical_turns(table(spark, sf_dir, "asr_segments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found_types(table(spark, sf_dir, "asr_segments"), table(spark, sf_dir, "entity_catalog"))


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.masked_segments(table(spark, sf_dir, "asr_segments"), table(spark, sf_dir, "entity_catalog"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("kind = 'copy'").select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents")).where("abusive").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, sf_dir, "documents"))


def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p3_found, p4_found, p5_found, p5_turns, p6_found, p6_masked, p7_ids, p8_found, p8_leaks, p9_found, p9_scores, p9_source_rates)}

#: The segments of asr_segments with both bounds and a known speaker, one row each.
_ASR = """
WITH raw AS (
  SELECT rec_id, seg_idx, CAST(round_even(least(start_s, end_s) * 1000.0, 0) AS BIGINT) AS s, CAST(round_even(greatest(start_s, end_s) * 1000.0, 0) AS BIGINT) AS e,
         TRY_CAST(nullif(regexp_extract(speaker, '([0-9]+)', 1), '') AS INTEGER) AS speaker, arrived_at
  FROM asr_segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND rec_id IS NOT NULL AND seg_idx IS NOT NULL),
seg AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY arrived_at, s, e, speaker) AS n FROM raw) WHERE n = 1 AND speaker IS NOT NULL)"""
_RUNS = f"""{_ASR},
flagged AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY rec_id ORDER BY s, e, seg_idx) THEN 0 ELSE 1 END AS f FROM seg),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY s, e, seg_idx) AS run FROM flagged),
runs AS (
  SELECT rec_id, any_value(speaker) AS speaker, arg_min(seg_idx, (s, e, seg_idx)) AS first_seg_idx, arg_max(seg_idx, (s, e, seg_idx)) AS last_seg_idx,
         count(*) AS n_events, min(s) AS start_ms, max(e) AS end_ms, max(e) - min(s) AS duration_ms
  FROM numbered GROUP BY rec_id, run HAVING count(*) >= 2)"""

SQL = {
    "p1_found": f"{_RUNS} SELECT rec_id, first_seg_idx, last_seg_idx FROM runs",
    "p1_runs": f"{_RUNS} SELECT rec_id, speaker, first_seg_idx, last_seg_idx, n_events, start_ms, end_ms, duration_ms FROM runs",
    "p3_found": f"""
WITH seg AS (SELECT rec_id, seg_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY arrived_at, text) AS n FROM asr_segments WHERE rec_id IS NOT NULL AND seg_idx IS NOT NULL) WHERE n = 1),
form AS (SELECT rec_id, seg_idx, text, {plain_text.plain_sql("text")} AS p FROM seg WHERE text IS NOT NULL)
SELECT a.rec_id, a.seg_idx AS seg_idx_a, b.seg_idx AS seg_idx_b FROM form a JOIN form b ON a.rec_id = b.rec_id AND a.p = b.p AND a.seg_idx < b.seg_idx AND a.text <> b.text WHERE a.p <> ''""",
    "p4_found": f"""{_ASR},
diar AS (
  SELECT DISTINCT rec_id, seg_idx, speaker, CAST(round_even(least(start_s, end_s) * 1000.0, 0) AS BIGINT) AS s
  FROM diar_segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL AND rec_id IS NOT NULL AND seg_idx IS NOT NULL),
pairs AS (
  SELECT a.rec_id, a.seg_idx AS asr_seg_idx, d.seg_idx AS diar_seg_idx,
         row_number() OVER (PARTITION BY a.rec_id, a.seg_idx ORDER BY abs(a.s - d.s), d.s, d.seg_idx) AS n
  FROM seg a JOIN diar d ON a.rec_id = d.rec_id AND a.speaker = d.speaker AND d.s BETWEEN a.s - 300 AND a.s + 300)
SELECT rec_id, asr_seg_idx, diar_seg_idx FROM pairs WHERE n = 1""",
}
