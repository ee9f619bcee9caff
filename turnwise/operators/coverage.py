"""Problem 2: overlapping, nested and touching intervals as continuous periods and the gaps between them.

Integer intervals [start, end) are decomposed into canonical dyadic blocks (level k, index i: [i 2^k, (i+1) 2^k)).
Blocks covered by an ancestor are removed, sibling pairs are merged upward and adjacent blocks are coalesced.  No block
is larger than a cell of 2^20 ms, so everything up to that level happens inside (entity, cell): an entity without end
is spread over its cells, and only each cell's first and last piece meet those of its neighbours.

Defined results: intervals without entity, bound or length take no part; exchanged bounds are put right; repeated
intervals change nothing; an empty table gives no period; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.sources.tables import written

LEVEL = 20
CELL = 1 << LEVEL
#: Rows that the Python worker handles at once, beyond the rows of one group.
CHUNK = 200_000


def dyadic_blocks(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and indices of the canonical blocks of the intervals; each interval lies within one cell."""
    levels, indices = [], []
    low, high = start.copy(), end.copy()
    for level in range(LEVEL):
        some = low < high
        left, right = some & (low & 1 == 1), some & (high & 1 == 1)
        for index in (low[left], high[right] - 1):
            indices.append(index)
            levels.append(np.full(len(index), level))
        low, high = (low + 1) >> 1, high >> 1
    rest = low[low < high]
    return np.concatenate([*levels, np.full(len(rest), LEVEL)]), np.concatenate([*indices, rest])


def uncovered(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct blocks that have no ancestor among the blocks."""
    at = index << level
    order = np.lexsort((-level, at))
    level, index, end = level[order], index[order], (at + (1 << level))[order]
    if not len(end):
        return level, index
    before = np.concatenate([[end[0] - 1], np.maximum.accumulate(end)[:-1]])
    keep = end > before
    return level[keep], index[keep]


def merged_siblings(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint blocks, with sibling pairs replaced by their parent, level after level."""
    levels, indices, carried = [], [], np.empty(0, np.int64)
    for k in range(LEVEL):
        own = np.sort(np.concatenate([index[level == k], carried]))
        pair = np.zeros(len(own), bool)
        pair[:-1] = (own[:-1] & 1 == 0) & (own[1:] == own[:-1] + 1)
        single = ~pair
        single[1:] &= ~pair[:-1]
        levels.append(np.full(int(single.sum()), k))
        indices.append(own[single])
        carried = own[pair] >> 1
    top = np.sort(np.concatenate([index[level == LEVEL], carried]))
    return np.concatenate([*levels, np.full(len(top), LEVEL)]), np.concatenate([*indices, top])


def coalesced(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the longest stretches of adjacent blocks."""
    start, size = index << level, 1 << level
    order = np.argsort(start)
    start, end = start[order], (start + size)[order]
    if not len(start):
        return start, end
    new = np.concatenate([[True], start[1:] != end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each (entity, cell), whose rows arrive together, and the gaps between them."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        names = table.column_names[:-2]
        keys = [table.column(n).combine_chunks() for n in names]
        codes = np.zeros(table.num_rows, bool)
        for key in keys:
            values = key.to_numpy(zero_copy_only=False)
            codes[1:] |= values[1:] != values[:-1]
        group = np.cumsum(codes)
        # Each group gets a stretch of its own, aligned to cells and apart from the others.
        shift = group.astype(np.int64) << (LEVEL + 1)
        start = table.column("s").to_numpy() + shift
        end = table.column("e").to_numpy() + shift
        low, high = coalesced(*merged_siblings(*uncovered(*dyadic_blocks(start, end))))
        of = (low >> (LEVEL + 1)).astype(np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts = np.diff(np.concatenate([firsts, [len(of)]]))
        rank = np.arange(len(of)) - np.repeat(firsts, counts)
        begins = np.flatnonzero(np.concatenate([[True], codes[1:]]))
        base = table.column("cell").to_numpy()[begins[of]] * CELL - (of << (LEVEL + 1))
        low, high = low + base, high + base
        edge = (rank == 0) | (rank == np.repeat(counts, counts) - 1)
        gap = np.flatnonzero(rank > 0)
        where = pa.array(np.concatenate([begins[of], begins[of][gap]]))
        kind = np.concatenate([np.where(edge, "edge", "period"), np.full(len(gap), "gap")])
        out = [key.take(where) for key in keys] + [pa.array(kind, pa.string()), pa.array(np.concatenate([low, high[gap - 1]])), pa.array(np.concatenate([high, low[gap]]))]
        yield pa.RecordBatch.from_arrays(out, [*names, "kind", "from_ms", "to_ms"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(n)[table.num_rows - 1].as_py() for n in table.column_names[:-2]]
        cut = table.num_rows
        same = np.ones(table.num_rows, bool)
        for n, value in zip(table.column_names[:-2], last):
            same &= table.column(n).to_numpy() == value
        cut = int(np.argmax(same))
        if cut:
            yield from solve(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if held:
        yield from solve(pa.Table.from_batches(held))


def periods_and_gaps(intervals: DataFrame, entity: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Continuous periods and gaps of each entity: the entity's columns, kind, from_ms, to_ms.

    ``start`` and ``end`` are bigint columns; the entity's columns are numbers.
    """
    low, high = F.least(start, end), F.greatest(start, end)
    known = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (low < high))
    for c in entity:
        known = known.where(F.col(c).isNotNull())
    cells = F.sequence(F.shiftright(low, LEVEL), F.shiftright(high - 1, LEVEL))
    cut = known.select(*entity, low.alias("_s"), high.alias("_e"), F.explode(cells).alias("cell"))
    local = cut.select(
        *entity, "cell", F.greatest(F.col("_s") - F.col("cell") * CELL, F.lit(0)).alias("s"), F.least(F.col("_e") - F.col("cell") * CELL, F.lit(CELL)).alias("e")
    ).distinct()
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in entity) + ", cell bigint, kind string, from_ms bigint, to_ms bigint"
    keys = [*entity, "cell"]
    pieces = written(local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cells, schema), "pieces")

    # Inside a cell every gap is final, and so is every piece but the first and the last; those meet their neighbours.
    out = [*entity, "kind", "from_ms", "to_ms"]
    over = Window.partitionBy(*entity).orderBy("from_ms")
    edges = pieces.where(F.col("kind") == "edge").withColumn("_last", F.lag("to_ms").over(over)).withColumn("_near", F.lag("cell").over(over) == F.col("cell"))
    edges = edges.withColumn("_new", F.when(F.col("_last") == F.col("from_ms"), 0).otherwise(1))
    edges = edges.withColumn("_run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*entity, "_run").agg(
        F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"), F.min(F.struct("from_ms", F.when(~F.col("_near"), F.col("_last")).alias("before"))).alias("_first")
    )
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_ms"), b.alias("to_ms"))
    before = F.col("_first.before")
    rows = F.when(before.isNull(), F.array(row("period", F.col("from_ms"), F.col("to_ms")))).otherwise(
        F.array(row("period", F.col("from_ms"), F.col("to_ms")), row("gap", before, F.col("from_ms")))
    )
    outer = joined.select(*entity, F.inline(rows))
    return pieces.where(F.col("kind") != "edge").select(*out).unionByName(outer.select(*out))
