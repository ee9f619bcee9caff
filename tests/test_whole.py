"""Queries over whole tables: texts that one way or another were left out before."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnwise.operators import text_clean
from turnwise.plans import privacy
from turnwise.plans.speech import _S

TEXTS = [
    (1, 0, "un deux"), (1, 1, "\u00a0déjà\u2007vu\u3000là "), (1, 2, "♪ la la ♪"), (1, 3, None), (1, 4, " \u2009 "), (1, 5, "a\u0085b\x0bc\u200bd"), (2, 0, "été"), (2, 1, None), (3, 0, None), (4, 0, "𝖣𝗈𝖼 ｅｔ\tκαι\n"),
]


def asr_folder(spark, path, rows):
    spark.createDataFrame(rows, "rec_id bigint, seg_idx int, text string").write.parquet(str(path / "asr_segments.parquet"))
    return str(path)


def test_text_counts_by_hand(spark, tmp_path):
    want = {}
    for rec, _, text in TEXTS:
        words, chars = want.get(rec, (0, 0))
        want[rec] = (words + len((text or "").split()), chars + len((text or "").strip()))
    got = entry.queries()["text_counts"](spark, asr_folder(spark, tmp_path, TEXTS)).collect()
    assert {r.rec_id: (r.n_words, r.n_chars) for r in got} == want and len(got) == len(want)


def test_text_counts_all_rows(spark, small):
    """The SQL over all rows, with blanks of any kind."""
    said = f"regexp_replace(coalesce(text, ''), '^{_S}+|{_S}+$', '', 'g')"
    sql = f"""SELECT rec_id, CAST(sum(CASE WHEN {said} = '' THEN 0 ELSE len(string_split_regex({said}, '{_S}+')) END) AS BIGINT) AS n_words, CAST(sum(length({said})) AS BIGINT) AS n_chars
FROM '{small}/asr_segments.parquet' GROUP BY rec_id"""
    got = entry.queries()["text_counts"](spark, small).select("rec_id", "n_words", "n_chars").collect()
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(sql).fetchall())


def gate_by_hand(original, corrected):
    """The two gates in plain Python, a blank before the colon of a tag allowed."""
    tags = lambda s: {t.replace(" ", "") for t in re.findall(r"SPEAKER_\d+ ?:", s)}
    lines = lambda s: re.findall(r"^(\s*SPEAKER_\d+ ?:\s*)", s, re.M)
    n, m = len(original.split()), len(corrected.split())
    opening = corrected.split("\n")[0].lower().startswith(("voici", "cette", "le texte", "analyse", "résumé", "thème"))
    listed = re.search(r"^\d+\.", corrected, re.M) or corrected.count("-") > n * 0.1
    same_tags = tags(original) == tags(corrected)
    return bool(same_tags and n * 0.5 <= m <= n * 1.5 and not opening and not listed), lines(original) == lines(corrected) and same_tags


def test_gates_take_any_text(spark):
    pairs = [
        ("un été là", "Résumé un été"), ("un été là", "THÈME : un été"), ("un été là", "Un été, là."), ("un deux trois quatre", "un deux trois quatre"),
        ("SPEAKER_0: été", "SPEAKER_0: Été"), ("SPEAKER_0: été", "SPEAKER_0:\u00a0Été"), ("a b", "a\u20281. b"), ("a b", "a\r1. b"), ("SPEAKER_0: a SPEAKER_1: b", "SPEAKER_0: a SPEAKER_1: b"),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = df.select("k", text_clean.passes_gate(F.col("a"), F.col("b")), text_clean.same_structure(F.col("a"), F.col("b"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [gate_by_hand(a, b) for a, b in pairs]


def told_by_recording(spark, folder):
    """rec_id: [(seg_idx, told)] in order, copies by the smallest text."""
    told = {}
    for r in spark.read.parquet(f"{folder}/asr_segments.parquet").select("rec_id", "seg_idx", "text").collect():
        own = told.setdefault(r.rec_id, {})
        own[r.seg_idx] = min((t for t in (own.get(r.seg_idx), r.text) if t is not None), default=None)
    return {rec: [(k, f"SPEAKER_{k % 2}: {own[k] or ''}") for k in sorted(own)] for rec, own in told.items()}


def test_llm_gate_has_all_texts(spark, small):
    told = told_by_recording(spark, small)
    got = {(r.rec_id, r.seg_idx): (r.passes, r.same) for r in entry.queries()["llm_gate"](spark, small).collect()}
    want = {(rec, a[0]): gate_by_hand(a[1], b[1]) for rec, rows in told.items() for a, b in zip(rows, rows[2:])}
    assert got == want and sum(not (a[1] + b[1]).isascii() for rows in told.values() for a, b in zip(rows, rows[2:])) > 300


def test_pairs_across_blocks(spark, tmp_path):
    """Blocks of many rows, of one row and without any; the last two segments of a recording have no partner."""
    places = [(1, k) for k in (*range(1003), 1700, 2600, 2601, 4000)] + [(2, 499), (2, 500), (2, 1000), (3, 7), (4, 0), (4, 999)]
    folder = asr_folder(spark, tmp_path, [(rec, k, f"mot {k}") for rec, k in places])
    told = told_by_recording(spark, folder)
    want = {(rec, rows[i][0]): (rows[i][1], rows[i + 2][1] if i + 2 < len(rows) else None) for rec, rows in told.items() for i in range(len(rows))}
    got = privacy._pairs(spark, folder).collect()
    assert {(r.rec_id, r.seg_idx): (r.original, r.corrected) for r in got} == want and len(got) == len(want)
    assert entry.queries()["llm_gate"](spark, folder).count() == sum(c is not None for _, c in want.values())
    clean = {(r.rec_id, r.seg_idx): r.text for r in entry.queries()["text_cleanup"](spark, folder).collect()}
    assert clean.keys() == want.keys()
    assert clean[1, 499] == "SPEAKER_1: Mot 499\nSPEAKER_1: Mot 501\n" and clean[1, 2601] == "SPEAKER_1: Mot 2601\n" and clean[2, 499] == "SPEAKER_1: Mot 499\nSPEAKER_0: Mot 1000\n"
