"""Problem 5: clean, ordered speaker turns from raw transcripts.

Labels inside a text are normalized and cut the text into pieces; time stamps, notes of sounds and hesitations are
stripped.  The label variants of each transcript are clustered by their initials and string similarity with
union-find (a label's number decides: equal numbers always meet, different ones never), pieces go under the canonical
speaker, and runs of one speaker collapse into turns, which carry their clean text where it is asked for.

Defined results: null and blank texts give no piece; pieces without a spoken word or of unknown speaker are left out and
do not interrupt; segments without recording, number or bound take no part; rows delivered twice count once; equal
starts are ordered by end, then seg_idx, then the piece's place in its text; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.segments import bounded_segments
from turnwise.operators.islands import BLOCK_MS, runs
from turnwise.sources.tables import written

#: A speaker label inside a text: in brackets, or followed by a colon or a dash; its number is captured.
LABEL = r"(?iu)(?:[\[<({]\s*(?:speaker|spk|locuteur|intervenant)[\s_-]*(\d+)\s*[\])>}]\s*:?|(?<![\p{L}\p{N}_])(?:speaker|spk|locuteur|intervenant)[\s_-]*(\d+)\s*(?::|\s[-–—](?=\s|$)))"
#: Time stamps of the transcription tools.
STAMP = r"(?iu)\d{1,3}(?::\d{2}){1,2}[.,]\d{1,3}\s*--?>\s*\d{1,3}(?::\d{2}){1,2}[.,]\d{1,3}|[\[<({]\s*(?:(?:ts|t|time)\s*[:=]\s*)?\d+(?::\d{2})*(?:[.,]\d+)?\s*s?\s*[\])>}]|(?<!\d)\d{1,3}(?::\d{2}){2}(?:[.,]\d+)?\s*(?:-(?=\s|$))?"
#: Words that notes of sounds are made of (fixed values, French and English).
SOUND_WORDS = (
    "applaudissements applaudissement applause claps clapping bruit bruits fond background noise noises crosstalk coughs cough coughing toux tousse door slams slam porte claque "
    "inaudible incompréhensible unintelligible laughter laughs laughing laugh rires rire rit music musique phone téléphone ringing rings sonnerie sonne silence pause sigh sighs sighing soupir soupirs soupire qui de du la le les of the"
)
_words = "|".join(sorted(set(SOUND_WORDS.split()), key=lambda w: (-len(w), w)))
#: Notes of sounds: anything in square, curly or angle brackets, stars or music signs; in round brackets only sound words.
NOTE = rf"(?iu)\[[^\[\]]*\]|\{{[^{{}}]*\}}|<[^<>]*>|\*[^*]*\*|[♪♫]+[^♪♫]*[♪♫]+|[♪♫]|\((?:\s*(?:{_words})[\s.,…'’!]*)+\)"
#: Hesitation sounds.
HESITATION = r"(?iu)(?<![\p{L}\p{N}'’])(?:e+u+h+|h+e+u+h*|h+u+m+|h+m+|u+h+m*|u+m+h*|e+r+m+|e+h+m*|m+h+m+)(?![\p{L}\p{N}'’])"
UNKNOWN = frozenset(["", "unknown", "inconnu", "na", "none", "null"])


def pieces_of(text: Column, label: Column) -> Column:
    """Array of (place, label, text): what holds from the start and from each label inside the text."""
    marked = F.regexp_replace(text, LABEL, "\u0001$1$2\u0002")
    parts = F.split(marked, "\u0001")
    return F.transform(
        parts,
        lambda x, i: F.struct(
            i.alias("place"),
            F.when(i == 0, label).otherwise(F.concat(F.lit("speaker "), F.substring_index(x, "\u0002", 1))).alias("label"),
            F.when(i == 0, x).otherwise(F.substring_index(x, "\u0002", -1)).alias("said"),
        ),
    )


def spoken(said: Column) -> Column:
    """A piece without stamps, notes of sounds and hesitations: what decides whether a word is left."""
    text = F.regexp_replace(said, STAMP, " ")
    text = F.regexp_replace(text, NOTE, " ")
    return F.regexp_replace(text, HESITATION, " ")


def cleaned(said: Column) -> Column:
    """A piece's spoken words as they are shown: single blanks, no punctuation before the first word."""
    text = F.regexp_replace(spoken(said), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(text, r"^[\s,.;:!?…-]+", ""))


def normalized(label: str) -> tuple[str, int | None]:
    """A label's letters, lower case, and its number."""
    digits = "".join(c if c.isdecimal() and c.isascii() else " " for c in label).split()
    number = int(digits[0]) if digits and int(digits[0]) < 1 << 31 else None
    return "".join(c for c in label.casefold() if c.isalpha()), number


def clusters(labels: list[str], alike: float = 0.8) -> dict[str, tuple[int | None, str | None]]:
    """The canonical speaker of each label of one transcript, as (number, name).

    Labels with one number meet by union-find, whatever their letters; labels with letters but no number meet others if
    they share the initial and their letters are ``alike``.  A cluster's speaker is its number; without one its name is the
    cluster's first label in the order of letters.  Labels that say unknown have neither.

    Only labels that share a pair of neighbouring letters (or are equal) are compared: no others can be alike.
    """
    known = {x: normalized(x) for x in labels}
    parent = {x: x for x in labels}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def meet(x: str, y: str) -> None:
        a, b = sorted((root(x), root(y)))
        parent[b] = a

    heads: dict[tuple, str] = {}
    pairs: dict[tuple[str, str], list[str]] = {}
    for x in sorted(labels):
        letters, number = known[x]
        if number is not None and letters in UNKNOWN - {""} or number is None and letters in UNKNOWN:
            continue
        head = heads.setdefault((number, None if number is not None else letters), x)
        if head != x:
            meet(x, head)
        elif number is None:
            own = {(letters[:1], letters[i : i + 2]) for i in range(max(1, len(letters) - 1))}
            for y in {y for pair in own for y in pairs.get(pair, ())}:
                if SequenceMatcher(None, letters, known[y][0]).ratio() >= alike:
                    meet(x, y)
            for pair in own:
                pairs.setdefault(pair, []).append(x)
    out: dict[str, tuple[int | None, str | None]] = {}
    for x, (letters, number) in known.items():
        unknown = number is not None and letters in UNKNOWN - {""} or number is None and letters in UNKNOWN
        out[x] = (None, None) if unknown else (number, None if number is not None else root(x))
    return out


def _canonical(transcript: pd.DataFrame) -> pd.DataFrame:
    found = clusters(transcript["label"].tolist())
    speakers = pd.array([found[x][0] for x in transcript["label"]], dtype="Int32")
    return pd.DataFrame({"rec_id": transcript["rec_id"], "label": transcript["label"], "speaker": speakers, "name": [found[x][1] for x in transcript["label"]]})


def label_clusters(labels: DataFrame) -> DataFrame:
    """rec_id, label -> speaker, name. Labels are made distinct first, so a transcript's group is as large as its variants."""
    own = labels.select("rec_id", "label").where(F.col("label").isNotNull()).distinct()
    spread = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id")
    return spread.groupBy("rec_id").applyInPandas(_canonical, "rec_id bigint, label string, speaker int, name string")


def spoken_pieces(segments: DataFrame, texts: bool = False) -> DataFrame:
    """Pieces with a spoken word: rec_id, seg_idx, start_ms, end_ms, place, label, and with ``texts`` their clean text, said.

    Texts are cut and judged where they are read; without ``texts`` only places and labels are shuffled, and no text is
    made that nothing reads.
    """
    cut = pieces_of(F.col("text"), F.lower(F.trim("speaker")))
    word = r"[\p{L}\p{N}]"
    shown = F.transform(cut, lambda p: F.struct(p["place"].alias("place"), p["label"].alias("label"), cleaned(p["said"]).alias("said")))
    kept = F.filter(shown, lambda p: p["said"].rlike(word)) if texts else F.filter(cut, lambda p: spoken(p["said"]).rlike(word))
    judged = segments.withColumn("_kept", F.when(F.col("text").rlike(word), kept))
    # The texts stand beside the pieces: of rows delivered twice the same one is taken with and without them.
    judged = judged.withColumn("_pieces", F.transform("_kept", lambda p: F.struct(p["place"].alias("place"), p["label"].alias("label"))))
    keep = ("_pieces", "_said") if texts else ("_pieces",)
    whole = bounded_segments(judged.withColumn("_said", F.col("_kept.said")), keep=keep)
    if not texts:
        return whole.select("rec_id", "seg_idx", "start_ms", "end_ms", F.inline("_pieces"))
    both = F.zip_with("_pieces", "_said", lambda p, t: F.struct(p["place"].alias("place"), p["label"].alias("label"), t.alias("said")))
    return whole.select("rec_id", "seg_idx", "start_ms", "end_ms", F.inline(both))


def placed_pieces(segments: DataFrame, texts: bool = False) -> DataFrame:
    """Spoken pieces under their canonical speakers; pieces and clusters are made once and written."""
    pieces = written(spoken_pieces(segments, texts), "pieces")
    return pieces.join(written(label_clusters(pieces), "speakers"), ["rec_id", "label"])


def _turns(placed: DataFrame, value: str, block_ms: int, text: str | None = None) -> DataFrame:
    turns = runs(placed.where(F.col(value).isNotNull()), ["rec_id"], value, ["start_ms", "end_ms", "seg_idx", "place"], block_ms, text)
    said = [F.array_join("texts", " ").alias("text")] if text else []
    return turns.select(
        "rec_id", value, F.col("first.seg_idx").alias("first_seg_idx"), F.col("last.seg_idx").alias("last_seg_idx"), F.col("n").alias("n_pieces"), F.col("first.start_ms").alias("start_ms"), F.col("until").alias("end_ms"), *said
    )


def speaker_turns(segments: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Turns of numbered speakers: rec_id, speaker, first_seg_idx, last_seg_idx, n_pieces, start_ms, end_ms."""
    return _turns(placed_pieces(segments), "speaker", block_ms)


def canonical_turns(segments: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """Turns of numbered speakers and of those that only have a name, with their clean text: rec_id, canonical, as
    ``speaker_turns``, and text.

    A numbered speaker's canonical label is the number, another's the first label of its cluster.
    """
    placed = placed_pieces(segments, texts=True)
    return _turns(placed.withColumn("canonical", F.coalesce(F.col("speaker").cast("string"), F.col("name"))), "canonical", block_ms, "said")
