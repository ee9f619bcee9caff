"""Problem 2 over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.segments import bounds
from turnwise.operators.coverage import periods_and_gaps
from turnwise.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = bounds(F.col("start_s"), F.col("end_s"))
    segments = table(spark, sf_dir, "diar_segments").select("rec_id", "speaker", start.alias("start_ms"), end.alias("end_ms"))
    return periods_and_gaps(segments, ["rec_id", "speaker"])


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
WITH seg AS (
  SELECT rec_id, speaker, CAST(round_even(least(start_s, end_s) * 1000.0, 0) AS BIGINT) AS s, CAST(round_even(greatest(start_s, end_s) * 1000.0, 0) AS BIGINT) AS e
  FROM diar_segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL AND rec_id IS NOT NULL),
new AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY rec_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n
  FROM (SELECT DISTINCT * FROM seg WHERE s < e)),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY rec_id, speaker ORDER BY s, e) AS run FROM new),
period AS (SELECT rec_id, speaker, min(s) AS from_ms, max(e) AS to_ms FROM numbered GROUP BY rec_id, speaker, run),
gap AS (SELECT rec_id, speaker, lag(to_ms) OVER (PARTITION BY rec_id, speaker ORDER BY from_ms) AS from_ms, from_ms AS to_ms FROM period)
SELECT rec_id, speaker, 'period' AS kind, from_ms, to_ms FROM period
UNION ALL SELECT rec_id, speaker, 'gap' AS kind, from_ms, to_ms FROM gap WHERE from_ms IS NOT NULL
""",
}
