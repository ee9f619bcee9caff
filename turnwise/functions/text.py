"""Text functions as column expressions; only callback capitalisation needs an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_ws(text: Column) -> Column:
    """Blanks of any kind as one space, none at the edges, null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without blanks of any kind at the edges."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_stutter(text: Column) -> Column:
    """``re-re-regarde`` as ``re-regarde``: a repeated word of up to four letters once."""
    return F.regexp_replace(normalize_ws(text), r"(?iU)\b(\w{1,4})(?:-\1)+\b", "$1")


def dialogue_spacing(text: Column) -> Column:
    """One space between words, none before and one after punctuation."""
    s = F.regexp_replace(stripped(text), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)\s+([,.;:!?])", "$1")
    return F.regexp_replace(s, r"(?U)([,.;:!?])(?=\S)", "$1 ")


def french_punctuation(text: Column) -> Column:
    """Spacing of punctuation, typographic apostrophes and elisions; sentence capitals are ``sentence_capitals``."""
    s = dialogue_spacing(text)
    s = F.replace(F.replace(F.replace(s, F.lit(" '"), F.lit(" ’")), F.lit("' "), F.lit("’ ")), F.lit("'"), F.lit("’"))
    return F.regexp_replace(s, r"(?U)\b([cdjlmnstCDJLMNST])\s*’\s*([aeéèêiouhAEÉÈÊIOUH])", "$1’$2")


_SENTENCE_START = re.compile(r"(^|[.!?]\s+)(\w)")


@F.pandas_udf(T.StringType())
def sentence_capitals(text: pd.Series) -> pd.Series:
    """A capital at the start of each sentence."""
    return text.map(lambda s: None if s is None else _SENTENCE_START.sub(lambda m: m[1] + m[2].upper(), s))


def clean_text(text: Column) -> Column:
    """Stutter, punctuation and capitals of a transcript piece."""
    return normalize_ws(sentence_capitals(french_punctuation(without_stutter(text))))


def folded_punctuation(text: Column) -> Column:
    """Dash and quote variants as plain ones, one space after an honorific before a capital."""
    s = F.translate(text, "‐‑‒–−’‘", "-----''")
    return F.regexp_replace(s, r"(?U)\b(Mme|Mlle|Me|Ma(?:ître|itre)|Dr|Pr|M\.)\s?(?=[A-ZÀ-ÖØ-Þ])", "$1 ")


def sentences(text: Column) -> Column:
    """Non-blank sentences: cut after . ? ! or a line end that blanks follow."""
    return F.filter(F.split(text, r"(?U)(?<=[.?!\n])\s+"), lambda s: s.rlike(r"(?U)\S"))


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null and blank texts."""
    s = stripped(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def line_count(text: Column) -> Column:
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.size(F.split(text, "\n")))


def speaker_index(label: Column) -> Column:
    """The number of ``SPEAKER_n``, ``SPKn`` or ``n``; 0 otherwise."""
    return F.coalesce(stripped(F.regexp_replace(F.upper(label), "SPEAKER_|SPK", "")).try_cast("int"), F.lit(0))


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, milliseconds rounded half to even; more than two digits of hours where needed."""
    ms = F.rint(seconds * F.lit(1000.0)).cast("long")
    part = lambda by, of: F.pmod(F.floor(ms / F.lit(by)), F.lit(of)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / F.lit(3_600_000)).cast("long"), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def path_component(text: Column) -> Column:
    """A text as a safe part of a file name."""
    s = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^[._]+|[._]+$", "")
    return F.when(F.length(s) == 0, F.lit("run")).otherwise(s)
