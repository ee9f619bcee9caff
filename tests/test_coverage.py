"""Continuous periods and gaps against a sweep, and against hand-made cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.operators import coverage as C


def sweep(intervals):
    """Periods by sorting: the plain way."""
    out = []
    for a, b in sorted((min(x), max(x)) for x in intervals):
        if a == b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(1, 700)), min_size=1, max_size=40))
def test_blocks_tile_and_coalesce(pairs):
    start = np.array([a for a, _ in pairs], np.int64)
    end = start + np.array([n for _, n in pairs])
    level, index = C.dyadic_blocks(start, end)
    assert (1 << level).sum() == (end - start).sum()
    level, index = C.merged_siblings(*C.uncovered(level, index))
    low, high = C.coalesced(level, index)
    assert list(zip(low.tolist(), high.tolist())) == sweep(list(zip(start.tolist(), end.tolist())))


def solve(spark, rows):
    df = spark.createDataFrame(rows, "rec_id bigint, speaker int, start_ms bigint, end_ms bigint, kind string")
    found = C.periods_and_gaps(df, ["rec_id", "speaker"]).collect()
    return sorted((r.rec_id, r.speaker, r.kind, r.from_ms, r.to_ms) for r in found)


def test_cases(spark):
    big = C.CELL
    rows = [
        (1, 0, 0, 10, "x"), (1, 0, 10, 20, None), (1, 0, 12, 15, "x"), (1, 0, 30, 25, "x"), (1, 0, 30, 30, "x"), (1, 0, 0, 10, "x"),
        (1, 1, 5, big * 3 + 7, "x"), (1, 1, big * 3 + 7, big * 3 + 9, "x"), (1, 1, big * 5, big * 5 + 1, "x"), (1, 1, big * 4 - 1, big * 4, "x"), (1, 1, big * 4, big * 4 + 2, "x"),
        (2, None, 0, 5, "x"), (2, 0, None, 5, "x"), (None, 0, 1, 5, "x"), (3, 2, -50, -10, "x"), (3, 2, -10, 4, "x"), (4, 1, 7, 7, "x"),
    ]
    assert solve(spark, rows) == [
        (1, 0, "gap", 20, 25), (1, 0, "period", 0, 20), (1, 0, "period", 25, 30),
        (1, 1, "gap", big * 3 + 9, big * 4 - 1), (1, 1, "gap", big * 4 + 2, big * 5), (1, 1, "period", 5, big * 3 + 9), (1, 1, "period", big * 4 - 1, big * 4 + 2), (1, 1, "period", big * 5, big * 5 + 1),
        (3, 2, "period", -50, 4),
    ]


def test_empty(spark):
    assert solve(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_sweep(spark, seed):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, 6 * C.CELL, 400)
    end = start + rng.integers(0, C.CELL // 2, 400) * (rng.random(400) < 0.9)
    rows = [(int(i % 3), int(i % 2), int(a), int(b), "x") for i, (a, b) in enumerate(zip(start, end))]
    expected = []
    for rec, speaker in {r[:2] for r in rows}:
        found = sweep([r[2:4] for r in rows if r[:2] == (rec, speaker)])
        expected += [(rec, speaker, "period", *p) for p in found] + [(rec, speaker, "gap", a[1], b[0]) for a, b in zip(found, found[1:])]
    assert solve(spark, rows) == sorted(expected)
