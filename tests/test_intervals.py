"""Speaker attachment, frame scores and gap merging: hand-made cases and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.segments import bounds, one_per_segment, speaker_number
from turnwise.operators import intervals as I
from turnwise.operators.islands import runs

SEG = "rec_id bigint, seg_idx bigint, start double, end double"


def attach(spark, diar, asr):
    d = spark.createDataFrame([(1, i, a, b, s) for i, (a, b, s) in enumerate(diar)], SEG + ", speaker int")
    a = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(asr)], SEG)
    return {r.seg_idx: (r.speaker, r.tier) for r in I.attach_speakers(d, a).collect()}


def test_attach_tiers(spark):
    diar = [(0.0, 2.0, 0), (1.5, 4.0, 1), (10.0, 11.0, 2), (20.0, 20.5, 1)]
    asr = [(0.0, 1.0), (1.2, 3.6), (11.2, 11.4), (30.0, 31.0), (4.0, 1.0), (8.9, 10.4), (20.53, 20.53), (1.6, 1.9)]
    got = attach(spark, diar, asr)
    assert got[0] == (0, 1)
    assert got[1] == (1, 1)  # midpoint in one only
    assert got[2] == (2, 3)  # 0.2 s away
    assert got[3] == (0, 4)  # far: the first segment's speaker
    assert got[4] == (1, 1)  # exchanged bounds
    assert got[5] == (2, 2)  # overlap only
    assert got[6] == (1, 1)  # within eps
    assert got[7] == (0, 1)  # both hold it with equal overlap: the earlier start


def test_attach_trivial(spark):
    assert attach(spark, [], [(0.0, 1.0)]) == {0: (0, 0)}
    assert attach(spark, [(5.0, 6.0, 7)], [(0.0, 1.0)]) == {0: (7, 0)}


def loop(diar, a0, a1, eps=0.05, tol=0.3):
    """The rule as a plain loop."""
    order = sorted(range(len(diar)), key=lambda i: diar[i][0])
    over = lambda d: max(0.0, min(a1, d[1] + eps) - max(a0, d[0] - eps))
    gap = lambda d: d[0] - a1 if a1 < d[0] else a0 - d[1] if d[1] < a0 else 0.0
    mid = 0.5 * (a0 + a1)
    hold = [i for i in order if diar[i][0] - eps <= mid <= diar[i][1] + eps]
    if hold:
        return diar[max(hold, key=lambda i: over(diar[i]))][2]
    best = max(order, key=lambda i: over(diar[i]))
    if over(diar[best]) > 0:
        return diar[best][2]
    near = min(order, key=lambda i: gap(diar[i]))
    return diar[near][2] if gap(diar[near]) <= tol else diar[order[0]][2]


def test_attach_random(spark):
    rng = np.random.default_rng(3)
    diar = [(round(float(s), 2), round(float(s + n), 2), int(k)) for s, n, k in zip(rng.random(60) * 120, rng.random(60) * 3, rng.integers(0, 3, 60))]
    asr = [(round(float(s), 2), round(float(s + n), 2)) for s, n in zip(rng.random(150) * 130, rng.random(150) * 2)]
    got = attach(spark, diar, asr)
    assert [got[i][0] for i in range(150)] == [loop(diar, *a) for a in asr]


def masks(p, on, off, silence, least):
    state, mask = False, []
    for x in p:
        state = (x >= off) if state else (x >= on)
        mask.append(state)
    out, start, last = [], None, None
    for i, m in enumerate(mask):
        if m:
            start, last = (i if start is None else start), i
        elif start is not None and i - last >= silence:
            if last + 1 - start >= max(1, least):
                out.append((start, last + 1))
            start = None
    if start is not None and len(p) - start >= max(1, least):
        out.append((start, len(p)))
    return mask, out


@pytest.mark.parametrize("seed", range(3))
def test_speech_runs(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.random(300).round(2).tolist()
    frames = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "rec_id bigint, frame_idx bigint, p double")
    mask, expected = masks(p, 0.7, 0.4, 2, 3)
    speech = I.hysteresis(frames, 0.7, 0.4, block=16)
    assert [r.speech for r in speech.orderBy("frame_idx").collect()] == mask
    got = I.speech_runs(speech, 2, 3, block=16).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == expected


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_merge_gaps(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 2000, 200), rng.integers(0, 40, 200))]
    expected = []
    for a, b in sorted(rows):
        if expected and a - expected[-1][1] <= 5:
            expected[-1][1] = max(expected[-1][1], b)
        else:
            expected.append([a, b])
    df = spark.createDataFrame([(1, a, b) for a, b in rows], "rec_id bigint, start bigint, end bigint")
    got = I.merge_gaps(df, ["rec_id"], 5, block).orderBy("start").collect()
    assert [[r.start, r.end] for r in got] == expected and sum(r.n for r in got) == 200


@pytest.mark.parametrize("block", [3, 100, 10_000])
def test_runs_in_blocks(spark, block):
    rng = np.random.default_rng(7)
    rows = [(1, int(t), int(i), int(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 300, 120), rng.integers(0, 3, 120)))]
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    expected, last = [], None
    for r in ordered:
        if r[3] == last:
            expected[-1][1:] = [r[2], expected[-1][2] + 1]
        else:
            expected.append([r[2], r[2], 1])
        last = r[3]
    df = spark.createDataFrame(rows, "rec_id bigint, at bigint, id bigint, v int")
    got = runs(df, ["rec_id"], "v", ["at", "id"], block).orderBy("first").collect()
    assert [[r["first"]["id"], r["last"]["id"], r.n] for r in got] == expected


def test_segment_columns(spark):
    rows = [(1.0004, 2.0006, "SPEAKER_07"), (2.0, 1.0, " s12 "), (None, 1.0, "n/a"), (float("nan"), 1.0, None), (0.0005, 0.0015, "99999999999")]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    s, e = bounds(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(s, e, speaker_number(F.col("label"))).collect()]
    assert got == [(1000, 2001, 7), (1000, 2000, 12), (None, None, None), (None, None, None), (0, 2, None)]


def test_one_per_segment(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-02", 5), (1, 1, "2024-01-01", 7), (1, None, None, 1), (None, 1, None, 1), (2, 1, None, 3)], "rec_id bigint, seg_idx bigint, d string, v int")
    got = one_per_segment(df.withColumn("arrived_at", F.col("d").cast("timestamp_ntz")), ["v"]).orderBy("rec_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 7), (2, 1, 3)]
