"""Problem 4: records of two tables paired with the nearest in time, as a stateful streaming join.

Both sides of an entity are buffered in its state.  Each entity keeps a watermark of its own (the latest time seen,
less the allowed lateness: times inside a recording tell nothing about other recordings).  A left row is emitted once
the watermark has passed its time by the tolerance, when no better right row can come; right rows that no waiting left
row can reach any more are evicted.  At the end of the input a last row beyond all times lets the rest time out.

An entity's time axis is cut into stretches with their own state, so that a recording without end is spread over
tasks; a right row within the tolerance of a cut goes to both sides.  Some neighbouring entities share one state row,
each with its own buffers and watermark: a call for every speaker of every recording would cost more than its work.

Defined results: rows without entity, id or time take no part; a left row without a right row within the tolerance
gives no row; on equal distance the earlier right row wins, then the smaller id; repeated rows count once; one right
row may serve several left rows; either side may be empty.  Rows that come after the watermark has passed them (only in
a live stream: a replay takes an entity's rows in one batch) are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnwise.functions.segments import bounds, speaker_number
from turnwise.sources.tables import scratch

TOLERANCE_MS = 300
STRETCH_MS = 1 << 22
#: The entity of the row that ends a replay.
END = -(1 << 62)
#: Its time; event time, which only drives the timeouts, stays below it.
END_MS = 9_000_000_000_000
#: Values of an entity's first column that share a state row.
BUNDLE = 8
#: Matrices as flat arrays: waiting left and reachable right rows (entity, time, id), and the latest time of each entity.
STATE = "left array<bigint>, right array<bigint>, seen array<bigint>"


def nearest(lt: np.ndarray, rt: np.ndarray, ri: np.ndarray, tolerance: int) -> np.ndarray:
    """For each left time the index of the nearest right row, or -1; right rows are ordered by (time, id)."""
    if not len(rt):
        return np.full(len(lt), -1)
    at = np.searchsorted(rt, lt, "left")
    after = np.minimum(at, len(rt) - 1)
    # The first row of the latest earlier time: among equal times the smaller id stands first.
    before = np.searchsorted(rt, rt[np.maximum(at - 1, 0)], "left")
    d_after = np.where(at < len(rt), rt[after] - lt, tolerance + 1)
    d_before = np.where(at > 0, lt - rt[before], tolerance + 1)
    best = np.where(d_before <= d_after, before, after)
    return np.where(np.minimum(d_before, d_after) <= tolerance, best, -1)


def _by_entity(rows: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entities (first ``wide`` columns) and each row's entity."""
    order = np.lexsort(rows[:, :wide].T[::-1])
    keys = rows[order, :wide]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    code = np.empty(len(rows), np.int64)
    code[order] = np.cumsum(new) - 1
    return keys[new], code


def joiner(wide: int, tolerance: int, lateness: int):
    """The state function of the entities (``wide`` columns) that share a state row."""

    def join(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [])
        left, right = (np.asarray(x, np.int64).reshape(-1, wide + 2) for x in held[:2])
        seen = np.asarray(held[2], np.int64).reshape(-1, wide + 1)
        if not state.hasTimedOut:
            parts = [f for f in frames if len(f)]
            new = np.stack([np.concatenate([f[c].to_numpy() for f in parts]) for c in [*(f"k{i}" for i in range(wide)), "at_ms", "id"]], axis=1)
            is_left = np.concatenate([f["is_left"].to_numpy() for f in parts])
            entities, code = _by_entity(np.concatenate([seen, new[:, : wide + 1]]), wide)
            known, code = code[: len(seen)], code[len(seen) :]
            last = np.full(len(entities), -(1 << 62))
            last[known] = seen[:, wide]
            fresh = new[:, wide] >= last[code] - lateness - tolerance
            np.maximum.at(last, code, new[:, wide])
            left, right = np.concatenate([left, new[fresh & is_left]]), np.concatenate([right, new[fresh & ~is_left]])
            seen = np.concatenate([entities, last[:, None]], axis=1)
        entities, code = _by_entity(np.concatenate([seen[:, :wide], left[:, :wide], right[:, :wide]]), wide)
        due = np.full(len(entities), 1 << 62)
        if not state.hasTimedOut:
            due[code[: len(seen)]] = seen[:, wide] - lateness - tolerance
        of_left, of_right = code[len(seen) : len(seen) + len(left)], code[len(seen) + len(left) :]
        ready = left[:, wide] < due[of_left]
        if ready.any() and len(right):
            rows, first = np.unique(np.stack([of_left[ready], left[ready, wide + 1]], axis=1), axis=0, return_index=True)
            times = left[ready, wide][first]
            # One axis for all entities, each in a stretch of its own.
            low = min(int(times.min()), int(right[:, wide].min()))
            span = max(int(times.max()), int(right[:, wide].max())) - low + 2 * tolerance + 2
            r = np.lexsort((right[:, wide + 1], right[:, wide], of_right))
            at = nearest(rows[:, 0] * span + times - low, of_right[r] * span + right[r, wide] - low, right[r, wide + 1], tolerance)
            hit = at >= 0
            if hit.any():
                got = right[r[at[hit]]]
                out = pd.DataFrame({"left_id": rows[hit, 1], "right_id": got[:, wide + 1], "distance_ms": np.abs(got[:, wide] - times[hit])})
                yield out.assign(**{f"k{i}": got[:, i] for i in range(wide)})
        if state.hasTimedOut:
            state.remove()
            return
        left, of_left = left[~ready], of_left[~ready]
        reach = due.copy()
        np.minimum.at(reach, of_left, left[:, wide])
        right = right[right[:, wide] >= reach[of_right] - tolerance]
        state.update((left.ravel().tolist(), right.ravel().tolist(), seen.ravel().tolist()))
        state.setTimeoutTimestamp(max(min(int(seen[:, wide].max()) + lateness + tolerance, END_MS - lateness - 1), state.getCurrentWatermarkMs() + 1, 1))

    return join


def nearest_stream(rows: DataFrame, entity: list[str], tolerance_ms: int = TOLERANCE_MS, lateness_ms: int = 0, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """The streaming join over ``rows``: the entity's bigint columns, is_left, id, at_ms; both sides in one stream.

    Result: the entity's columns, left_id, right_id, distance_ms.
    """
    own = F.floor(F.col("at_ms") / F.lit(stretch_ms)).cast("long")
    # A right row is also wanted in the neighbouring stretches that it can reach.
    reached = F.sequence(F.floor((F.col("at_ms") - tolerance_ms) / F.lit(stretch_ms)).cast("long"), F.floor((F.col("at_ms") + tolerance_ms) / F.lit(stretch_ms)).cast("long"))
    stretches = F.when(F.col("is_left"), F.array(own)).otherwise(reached)
    known = rows.where(F.col("at_ms").isNotNull() & F.col("id").isNotNull())
    for c in entity:
        known = known.where(F.col(c).isNotNull())
    keys = [f"k{i}" for i in range(len(entity))]
    spread = known.select(*[F.col(c).cast("long").alias(k) for c, k in zip(entity, keys)], F.explode(stretches).alias("stretch"), "is_left", "id", "at_ms")
    spread = spread.withColumn("bundle", F.floor(F.col("k0") / F.lit(BUNDLE)).cast("long"))
    # Spark takes rows at the watermark itself, which starts at 0, as late: event time begins after it.
    timed = spread.withColumn("ts", F.timestamp_millis(F.greatest(F.least(F.col("at_ms"), F.lit(END_MS)), F.lit(0)) + 1)).withWatermark("ts", f"{lateness_ms} milliseconds")
    out = "left_id bigint, right_id bigint, distance_ms bigint, " + ", ".join(f"{k} bigint" for k in keys)
    joined = timed.groupBy("bundle", "stretch").applyInPandasWithState(joiner(len(keys), tolerance_ms, lateness_ms), out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(entity)], "left_id", "right_id", "distance_ms")


def replayed(tables: list[DataFrame], ending: DataFrame, ending_at: str, entity: list[str], tolerance_ms: int = TOLERANCE_MS, lateness_ms: int = 0) -> DataFrame:
    """The streaming join over bounded streams, run to its end; its result is kept in the shared folder.

    ``ending`` streams the folder ``ending_at``, which is still empty: the row that lets the rest time out is written there
    when all batches are done, and the query goes on from its state.  Streams may come in any number of micro-batches;
    rows that arrive up to ``lateness_ms`` out of order between batches are joined as if they came in one.
    """
    spark = ending.sparkSession
    rows = tables[0]
    for other in [*tables[1:], ending]:
        rows = rows.unionByName(other)
    joined = nearest_stream(rows, entity, tolerance_ms, lateness_ms)
    result, at = scratch(spark, "nearest"), scratch(spark, "nearest-state")
    for last in (False, True):
        if last:
            values = {"is_left": F.lit(True), "id": F.lit(0).cast("long"), "at_ms": F.lit(END_MS)} | {c: F.lit(END if c == entity[0] else 0).cast("long") for c in entity}
            spark.range(1).select(*[values[c].alias(c) for c in ending.columns]).write.mode("append").parquet(ending_at)
        query = joined.writeStream.format("parquet").option("path", result).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(joined.schema).parquet(result)


def side(segments: DataFrame, is_left: bool, speaker: Column) -> DataFrame:
    """Segments as rows of the join; a segment without a bound, speaker or recording takes no part."""
    start, _ = bounds(F.col("start_s"), F.col("end_s"))
    return segments.select("rec_id", speaker.cast("long").alias("speaker"), F.lit(is_left).alias("is_left"), F.col("seg_idx").alias("id"), start.alias("at_ms"))


def nearest_diarization(asr: DataFrame, diar: DataFrame, ending_at: str, tolerance_ms: int = TOLERANCE_MS, lateness_ms: int = 0) -> DataFrame:
    """For each ASR segment the diarization segment with the nearest start: rec_id, speaker, asr_seg_idx, diar_seg_idx, distance_ms.

    ``asr`` and ``diar`` are streams of the tables; ``ending_at`` is a new folder for the row that ends the replay.
    """
    spark = asr.sparkSession
    schema = "rec_id bigint, speaker bigint, is_left boolean, id bigint, at_ms bigint"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(ending_at)
    ending = spark.readStream.schema(schema).parquet(ending_at)
    left, right = side(asr, True, speaker_number(F.col("speaker"))), side(diar, False, F.col("speaker"))
    found = replayed([left, right], ending, ending_at, ["rec_id", "speaker"], tolerance_ms, lateness_ms)
    return found.select("rec_id", "speaker", F.col("left_id").alias("asr_seg_idx"), F.col("right_id").alias("diar_seg_idx"), "distance_ms")


def table_stream(df: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table at ``path``, a file or a folder, as a stream with the columns of ``df``.

    A file stream takes a single file only by a pattern; this one matches nothing but the path itself.
    """
    stream = df.sparkSession.readStream.schema(df.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")
