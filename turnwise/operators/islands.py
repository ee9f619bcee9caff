"""Runs of equal neighbours in an ordered sequence, found in blocks so that no sequence needs to fit one task.

A window over a whole sequence puts it into one task.  Here the sequence is cut into blocks of its time axis; the
window works on (sequence, block), and only the first and the last run of each block (two rows a block) meet in a
second window over the sequence, where runs that cross the cut are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 600_000


def runs(df: DataFrame, sequence: list[str], value: str, order: list[str], block_ms: int = BLOCK_MS, text: str | None = None) -> DataFrame:
    """The longest runs of equal ``value`` in each sequence, ordered by ``order`` (its first column: milliseconds).

    Result: the sequence's columns, ``value``, ``n`` (events of the run), ``first`` and ``last`` (structs of ``order``)
    and ``until`` (the latest ``end_ms``, else the last event's first order column).  ``value`` may be null: nulls are
    equal to each other.  With ``text`` the column ``texts`` holds its values in order.
    """
    seq = [F.col(c) for c in sequence]
    place = F.struct(*order)
    end = F.col("end_ms") if "end_ms" in df.columns else F.col(order[0])
    said = [F.col(text).alias("_text")] if text else []
    slim = df.select(*seq, F.col(value), *[F.col(c) for c in order if c not in sequence], *said, end.alias("_end"), F.floor(F.col(order[0]) / F.lit(block_ms)).cast("long").alias("_block"))
    in_block = Window.partitionBy(*sequence, "_block")
    at = in_block.orderBy(*order)
    first_row = F.row_number().over(at) == 1
    changed = F.when(first_row | ~F.col(value).eqNullSafe(F.lag(value).over(at)), 1).otherwise(0)
    numbered = slim.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    texts = [F.transform(F.array_sort(F.collect_list(F.struct(*order, "_text"))), lambda x: x["_text"]).alias("texts")] if text else []
    parts = numbered.groupBy(*sequence, "_block", "_run").agg(
        *texts, F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.max("_end").alias("until")
    )
    parts = parts.withColumn("_of", F.max("_run").over(in_block))
    inner = parts.where((F.col("_run") > 1) & (F.col("_run") < F.col("_of")))
    edges = parts.where((F.col("_run") == 1) | (F.col("_run") == F.col("_of")))
    over = Window.partitionBy(*sequence).orderBy("_block", "_run")
    joins = (F.col("_run") == 1) & (F.lag("_block").over(over) < F.col("_block")) & F.col(value).eqNullSafe(F.lag(value).over(over))
    edges = edges.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    texts = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "texts"))), lambda x: x["texts"])).alias("texts")] if text else []
    joined = edges.groupBy(*sequence, "_run").agg(
        *texts, F.first(value).alias(value), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("until").alias("until")
    )
    out = [*sequence, value, "n", "first", "last", "until", *(["texts"] if text else [])]
    return inner.select(*out).unionByName(joined.select(*out))
