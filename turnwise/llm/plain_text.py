"""Problem 3: one consistent form for texts that look the same but differ in their characters.

DuckDB runs inside the Arrow partitions: ``translate`` maps typographic variants (full-width, mathematical and other
presentation forms of letters, digits and marks) and look-alike letters of other scripts to plain ones, regular
expressions drop invisible characters, expand ligatures and make blank space one space, and ``nfc_normalize`` composes
accents.  Case, accents and visible punctuation stay.

Defined results: null stays null; a text of blanks and invisible characters becomes the empty text; the order of rows
is kept and other columns pass through; texts of any length are processed whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions.segments import one_per_segment
from turnwise.sources.tables import written

# Letters of other scripts that read as a Latin letter, each followed by that letter.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κк", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ",
    "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "ë": "ё", "ï": "ї", "Ë": "Ё", "Ï": "Ї", "-": "‐‑⁃﹣－‒",
}
#: Characters that are not seen, as a class of the expression language.
UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
#: Blank space of any kind.
BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+"


@cache
def variants() -> tuple[dict[str, str], dict[str, str]]:
    """By rule, from the character database: characters that stand for one plain character, and ligatures."""
    one, more = {}, {}
    for code in [*range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if kind in ("<font>", "<wide>", "<narrow>", "<compat>") and plain != c and plain.isascii():
            (one if len(plain) == 1 else more)[c] = plain
    one |= {c: plain for plain, like in LOOK_ALIKES.items() for c in like}
    return one, {c: plain for c, plain in more.items() if plain.isalpha()}


@cache
def plain_sql(column: str) -> str:
    """The expression that brings ``column`` to the consistent form, in DuckDB's SQL."""
    one, more = variants()
    text = f"translate({column}, '{''.join(one)}', '{''.join(one.values()).replace(chr(39), chr(39) * 2)}')"
    for c, plain in more.items():
        text = f"replace({text}, '{c}', '{plain}')"
    # The table is long and texts beyond Latin letters are few; the others skip it.
    text = f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x{{024F}}]') THEN {text} ELSE {column} END"
    text = f"regexp_replace({text}, '{UNSEEN}', '', 'g')"
    text = f"nfc_normalize(trim(regexp_replace({text}, '{BLANK}', ' ', 'g')))"
    quick = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({column}, '[^\\x20-\\x7E]') THEN {text} ELSE {quick} END"


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(config={"threads": 1})
    for batch in batches:
        texts = pa.table({"t": batch.column(batch.num_columns - 1)})
        db.register("texts", texts)
        done = db.sql(f"SELECT {plain_sql('t')} AS t FROM texts").to_arrow_table().column("t").combine_chunks()
        db.unregister("texts")
        yield pa.RecordBatch.from_arrays([*batch.columns, done.cast(pa.string())], [*batch.schema.names, "_plain"])


def with_plain_text(df: DataFrame, text: str, into: str = "plain_text") -> DataFrame:
    """``df`` with the consistent form of the column ``text`` added as ``into`` (which may not exist yet)."""
    names = [c for c in df.columns if c != text]
    inner = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*inner.schema.fields, T.StructField("_plain", T.StringType())])
    done = inner.mapInArrow(_plain, schema)
    back = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(names)} | {text: F.col("_text").alias(text)}
    return done.select(*[back[c] for c in df.columns], F.col("_plain").alias(into))


def reading_classes(segments: DataFrame) -> DataFrame:
    """rec_id, seg_idx, form, way of each segment with a non-blank text, written once: hashes of how it reads (128 bits)
    and, within that, of how it is written (64 bits)."""
    slim = one_per_segment(segments.select("rec_id", "seg_idx", "text", *[c for c in ("arrived_at",) if c in segments.columns]), ["text"])
    plain = with_plain_text(slim.where(F.col("text").isNotNull()), "text").where(F.col("plain_text") != "")
    form = F.struct(F.xxhash64("plain_text").alias("a"), F.xxhash64(F.lit(7), "plain_text").alias("b"))
    return written(plain.select("rec_id", "seg_idx", form.alias("form"), F.xxhash64("text").alias("way")), "readings")


def same_reading(segments: DataFrame) -> DataFrame:
    """Pairs of segments of one recording whose non-blank texts differ but read the same: rec_id, seg_idx_a, seg_idx_b.

    Texts meet by (recording, consistent form), so a recording that holds a third of the rows is spread.  Only forms
    written in two or more ways go on, which are few; the ways are paired, not the segments, so that copies of one text
    never meet each other.  ``reading_classes`` has the membership without pairs.
    """
    keyed = reading_classes(segments)
    several = keyed.groupBy("rec_id", "form").agg(F.min("way").alias("low"), F.max("way").alias("high")).where(F.col("low") != F.col("high")).select("rec_id", "form")
    members = written(keyed.join(several, ["rec_id", "form"]), "several-ways")
    ways = members.select("rec_id", "form", "way").distinct()
    pairs = ways.withColumnRenamed("way", "way_a").join(ways.withColumnRenamed("way", "way_b"), ["rec_id", "form"]).where(F.col("way_a") < F.col("way_b"))
    a = members.select("rec_id", "form", F.col("way").alias("way_a"), F.col("seg_idx").alias("seg_a"))
    b = members.select("rec_id", "form", F.col("way").alias("way_b"), F.col("seg_idx").alias("seg_b"))
    met = pairs.join(a, ["rec_id", "form", "way_a"]).join(b, ["rec_id", "form", "way_b"])
    return met.select("rec_id", F.least("seg_a", "seg_b").alias("seg_idx_a"), F.greatest("seg_a", "seg_b").alias("seg_idx_b"))
