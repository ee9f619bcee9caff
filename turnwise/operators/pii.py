"""Detection and resolution of personal data spans: rows (doc_id, start, end, entity_type, score, source, ord).

Offsets count code points from 0.  Detectors scan texts in Arrow batches (Spark has no function for all offsets of a
pattern); everything after is relational or a fold over one document's sorted spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns, in the order that decides ties.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{2,4}\)?[\s.\-]?){2,5}\d{2,4}"
IBAN = r"\b[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}\b"
SIREN_SIRET = r"\b(?:\d{9}|\d{14})\b"
DATE = (
    r"\b(?:\d{1,2}[\/\-\.:]\d{1,2}[\/\-\.:]\d{2,4}|\d{4}[\/\-\.:]\d{1,2}[\/\-\.:]\d{1,2}"
    r"|(?:\d{1,2}\s+)?(?:janv\.?|févr\.?|mars|avr\.?|mai|juin|juil\.?|août|sept\.?|oct\.?|nov\.?|déc\.?)\s+\d{2,4})\b"
)
STRUCTURED = {"EMAIL": EMAIL, "PHONE": PHONE, "IBAN": IBAN, "SIREN_SIRET": SIREN_SIRET, "DATE": DATE}
#: A label's rank when one surface has several.
PRIORITY = {"PERSON": 4, "ORGANIZATION": 4, "LOCATION": 3, "PHONE": 3, "EMAIL": 3, "IBAN": 3, "SIREN_SIRET": 3, "DATE": 2, "URL": 2, "MISC": 1}
VERBS = ("a", "avait", "est", "était", "sera", "serait")
DETERMINERS = frozenset("la le les une un des du de d l au aux".split())
NOUNS = frozenset("vie faune flore ressource ressources biodiversite milieu milieux industrie industries ministere ministeres arme armee marine justice police".split())
FOLLOWING = frozenset("fragile fragiles durable durables maritime maritimes marchande marchandes nationale nationales militaire militaires protegee protegees sensible sensibles".split())

SPAN = "array<struct<start:int,end:int,entity_type:string,score:double,source:string,surface:string,near_speaker:boolean,common:boolean>>"
FIELDS = ("start", "end", "entity_type", "score", "source")
Scan = Callable[[str], Iterable[tuple[int, int, str, float, str]]]
_HOLDS = {"EMAIL": 1, "PHONE": 2, "IBAN": 2, "SIREN_SIRET": 2}
_TWO_DIGITS = re.compile(r"\d\d")
_EDGE = " \"'«»“”‘’()[]{}<>"


def context_of(text: str, start: int, end: int) -> tuple[str, bool, bool]:
    """A span's surface without quotes and brackets at its edges, whether it is part of a speaker's label, and whether
    its neighbours show a common noun."""
    surface = " ".join(text[start:end].split()).strip(_EDGE)
    line = text.rfind("\n", 0, start) + 1
    label = _LABEL.match(text, line)
    inside = label is not None and start < label.end() or "speaker" in text[start:end].lower()
    return surface, inside, common_noun(text, start, end)


def spans_of(docs: DataFrame, *scans: Scan) -> DataFrame:
    """The spans that ``scans`` yield for each (doc_id, text), in one pass: FIELDS, surface, near_speaker, common, ord.

    ``ord`` counts a text's spans in the order of scans, then of their places in its output.
    """

    @F.pandas_udf(SPAN)
    def found(text: pd.Series) -> pd.Series:
        names = (*FIELDS, "surface", "near_speaker", "common")
        return text.map(lambda t: [dict(zip(names, (*s, *context_of(t, s[0], s[1])))) for scan in scans for s in scan(t)] if t else [])

    spans = docs.select("doc_id", F.posexplode(found("text")).alias("ord", "_s"))
    return spans.select("doc_id", "_s.*", F.col("ord").cast("long").alias("ord"))


def with_context(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of a model (doc_id, FIELDS, ord) with surface, near_speaker and common, read from their texts."""

    @F.pandas_udf("struct<surface:string,near_speaker:boolean,common:boolean>")
    def read(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = [context_of(t, int(a), int(b)) for t, a, b in zip(text, start, end)]
        return pd.DataFrame(rows, columns=["surface", "near_speaker", "common"])

    joined = spans.join(docs.select("doc_id", "text").where(F.col("text").isNotNull()), "doc_id").withColumn("_c", read("text", "start", "end"))
    return joined.select("doc_id", *FIELDS, "_c.*", F.col("ord").cast("long").alias("ord"))


def structured_scan(labels: Iterable[str] = ("EMAIL", "PHONE", "IBAN", "SIREN_SIRET")) -> Scan:
    """Matches of the patterns, in their order; texts without the sign or the two digits that each of a pattern's matches
    holds are not searched for it."""
    patterns = [(label, re.compile(STRUCTURED[label], re.I), _HOLDS.get(label, 0)) for label in labels]

    def scan(text: str) -> list[tuple[int, int, str, float, str]]:
        holds = True, "@" in text, _TWO_DIGITS.search(text) is not None
        return [(*m.span(), label, 1.0, "regex") for label, p, needs in patterns if holds[needs] for m in p.finditer(text)]

    return scan


class CatalogScan:
    """All occurrences of catalog entries, in any case; those of one entry don't overlap.

    One pass over the text by an Aho-Corasick automaton, built once in each worker, so that the time does not grow with
    the catalog; without that library each entry is searched by itself.
    """

    def __init__(self, entries: Iterable[tuple[str, str]], whole_words: bool, score: float, source: str, as_person: bool = False) -> None:
        self.entries = [(p, "PERSON" if as_person else label) for p, label in entries if p]
        self.whole_words, self.score, self.source = whole_words, score, source
        self.automaton = None

    def hits(self, low: str) -> Iterable[tuple[int, int]]:
        """(place, entry) in the order of entries, then places; occurrences may overlap."""
        try:
            import ahocorasick
        except ImportError:
            return [(m.start(), k) for k, (p, _) in enumerate(self.entries) if p.lower() in low for m in re.finditer(f"(?={re.escape(p.lower())})", low)]
        if self.automaton is None:
            table: dict[str, list[int]] = {}
            for k, (p, _) in enumerate(self.entries):
                table.setdefault(p.lower(), []).append(k)
            self.automaton = ahocorasick.Automaton()
            for word, numbers in table.items():
                self.automaton.add_word(word, (len(word), numbers))
            self.automaton.make_automaton()
        found = [(k, end - n + 1) for end, (n, numbers) in self.automaton.iter(low) for k in numbers] if self.entries else []
        return [(at, k) for k, at in sorted(found)]

    def __call__(self, text: str) -> list[tuple[int, int, str, float, str]]:
        low = text.lower()
        if len(low) != len(text) or "Σ" in text:  # letters of two small ones, and the one whose small form hangs on its place
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, last, free = [], -1, 0
        for at, k in self.hits(low):
            pattern, label = self.entries[k]
            end = at + len(pattern)
            if k == last and at < free:
                continue
            if self.whole_words:
                inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
                if inner(at - 1) == inner(at) or inner(end - 1) == inner(end) or common_noun(text, at, end):
                    continue
            last, free = k, end
            out.append((at, end, label, self.score, self.source))
        return out


catalog_scan = CatalogScan


_FOLD = str.maketrans("àâäçéèêëîïôöùûüÿñ", "aaaceeeeiioouuuyn")
_WINDOW = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ']+")
_LABEL = re.compile(r"\s*SPEAKER_\d+\s*:")


def _neighbours(text: str) -> list[str]:
    return _WINDOW.findall(text.lower().translate(_FOLD))


def common_noun(text: str, start: int, end: int) -> bool:
    """A surface written small that a determiner or a noun precedes, or that an adjective of the list follows.

    Two words before and one after count, as far as 30 letters show them.
    """
    if not text[start:end].strip().islower():
        return False
    two_before = _neighbours(text[max(0, start - 30) : start])[-2:]
    one_after = _neighbours(text[end : end + 30])[:1]
    return not NOUNS.isdisjoint(two_before) or not DETERMINERS.isdisjoint(two_before[-1:]) or not FOLLOWING.isdisjoint(one_after)


# What stands before a person's or a firm's name, and a capitalised first word that a verb follows.
_LEADING = re.compile(rf"(?:^|(?<=[.!?]\s))([A-ZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸ][a-zàâäçéèêëîïôöùûüÿ'\-]+)\s+(?:{'|'.join(VERBS)})\b", re.M)
_AFTER = re.compile(r"(?:avec|chez|par|M\.|Mme|Mlle|Dr|Me)\s+([A-Z][a-zàâäéèêëïîôùûü]+)")
_FIRM = re.compile(r"\b(?:Cabinet|Société|SA|SARL|SAS)\s+([A-Z][a-zA-Zàâäéèêëïîôùûü\s]+?)(?=\s|,|\.|$)")


def context_scan(known: frozenset[str] = frozenset()) -> Scan:
    """Names told by what stands before them, or by a verb after the first word of a sentence."""

    def scan(text: str) -> list[tuple[int, int, str, float, str]]:
        out = [(*m.span(1), "PERSON", 0.75, "pattern") for m in _AFTER.finditer(text)]
        out += [(*m.span(1), "ORGANIZATION", 0.8, "pattern") for m in _FIRM.finditer(text) if len(m[1].strip()) > 3]
        out += [(*m.span(1), "PERSON", 0.65, "pattern_leading") for m in _LEADING.finditer(text) if m[1].lower() not in known]
        return out

    return scan


def detected(docs: DataFrame, catalog: Iterable[tuple[str, str]] = (), given: DataFrame | None = None) -> DataFrame:
    """All detectors' spans, in the order model (``given``), catalog, context, structure; texts are read once."""
    entries = list(catalog)
    known = frozenset(p.lower() for p, _ in entries)
    scans = [catalog_scan(entries, True, 1.0, "domain")] if entries else []
    found = spans_of(docs, *scans, context_scan(known), structured_scan())
    # Model spans come first: their own order is kept below that of all others.
    return found if given is None else with_context(given.withColumn("ord", F.col("ord") - F.lit(1 << 40)), docs).unionByName(found)


def structured_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the number of matches of each structured pattern in each text; counted in the JVM."""
    text = F.coalesce("text", F.lit(""))
    count = lambda name: F.regexp_count(text, F.lit(f"(?i){STRUCTURED[name]}")).alias(f"n_{name.lower()}")
    return docs.select("doc_id", *[count(name) for name in STRUCTURED])


def entity_type(label: Column) -> Column:
    """A detector's type as one of the types used here; the first rule that holds decides."""
    t = F.upper(F.trim(label))
    return (
        F.when(t.isin("PER", "PERSON"), "PERSON").when(t.isin("ORG", "ORGANIZATION", "COMPANY"), "ORGANIZATION").when(t.isin("LOC", "LOCATION", "GPE"), "LOCATION")
        .when(t.contains("PHONE") | t.isin("TEL", "MOBILE"), "PHONE").when(t.contains("EMAIL"), "EMAIL").when(t.contains("IBAN") | t.contains("CARD"), "IBAN")
        .when(t.contains("ACCOUNT") | t.contains("RIB"), "ACCOUNT").when(t.isin("SIREN", "SIRET", "SIREN_SIRET"), "SIREN_SIRET").when(t.contains("DATE"), "DATE")
        .when(t.contains("URL") | t.contains("LINK"), "URL").otherwise("MISC")
    )


def type_priority(label: Column) -> Column:
    out = F.lit(2)
    for name, rank in PRIORITY.items():
        out = F.when(label == name, rank).otherwise(out)
    return out


def ner_gate(spans: DataFrame, named: float = 0.65, other: float = 0.70) -> DataFrame:
    """Model spans with a sound place and enough score for their type; prefixes of chunk tags are folded."""
    kind = F.regexp_replace(F.upper("entity_type"), "^[BI]-", "")
    least = F.when(kind.isin("PER", "PERSON", "ORG", "LOC"), named).otherwise(other)
    return spans.withColumn("entity_type", kind).where((F.col("score") >= least) & (F.col("start") >= 0) & (F.col("end") > F.col("start")))


def words_in(surface: Column) -> Column:
    """The small-letter words of a surface, cut at blanks, punctuation, hyphens and brackets."""
    return F.filter(F.split(F.lower(surface), r"(?U)[\s,.;:!?()-]+"), lambda w: F.length(w) > 0)


def usable(spans: DataFrame, persons: Iterable[str] = (), generic: Iterable[str] = (), whitelist: Iterable[str] = (), own: Column | None = None) -> DataFrame:
    """Spans whose surface may be an entity: rules on length, case, letters and words.

    Needs ``surface``, ``near_speaker`` and a normalised ``entity_type``.  Surfaces of ``whitelist`` and parts of speaker
    labels are dropped, and surfaces of ``generic``, structured types excepted.  Unless a span is the domain's ``own``, a
    word of ``generic`` in it drops it, a word of ``persons`` drops a person, and so do the rules on form.
    """
    s, low = F.col("surface"), F.lower("surface")
    words = F.split(s, r"\s+")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    numeric = F.col("entity_type").isin("PHONE", "EMAIL", "IBAN", "SIREN_SIRET", "DATE", "URL")
    small = s == low
    persons, generic, whitelist = (list(x) for x in (persons, generic, whitelist))
    among = lambda values: low.isin(*values) if values else F.lit(False)
    holds = lambda values: among(values) | F.arrays_overlap(words_in(s), F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
    noise = ((F.size(words) > 1) & (capitals == 0)) | ((F.col("entity_type") == "MISC") & small) | (F.length(s) <= 2) | (small & (F.length(s) <= 3)) | (F.length(F.regexp_replace(s, r"\P{L}", "")) <= 1)
    own = F.lit(False) if own is None else own
    blocked = holds(generic) | ((F.col("entity_type") == "PERSON") & holds(persons))
    kept = spans.where((F.length(s) >= 2) & ~F.col("near_speaker") & ~among(whitelist))
    return kept.where((numeric | (~among(generic) & (own | ~noise))) & (own | ~blocked))


def refined_type(surface: Column, label: Column) -> Column:
    """MISC of up to three capitalised words is a person; an organisation written small is MISC."""
    words = F.filter(F.split(surface, r"[\s-]+"), lambda w: F.length(w) > 0)
    names = (F.size(words) > 0) & (F.size(words) <= 3) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*$"))
    return F.when((label == "MISC") & names, "PERSON").when((label == "ORGANIZATION") & (surface == F.lower(surface)), "MISC").otherwise(label)


def best_labels(spans: DataFrame) -> DataFrame:
    """One label for each (doc_id, surface in any case): the highest priority, then score, then the first."""
    rank = F.struct(-type_priority(F.col("entity_type")), -F.col("score"), "ord", "entity_type")
    best = spans.groupBy("doc_id", F.lower("surface").alias("surface_lower")).agg(F.min(rank).alias("_best"))
    return best.select("doc_id", "surface_lower", F.col("_best.entity_type").alias("label"))


def with_best_label(spans: DataFrame) -> DataFrame:
    """``spans`` with ``label`` as in ``best_labels``; spans are read once, and those without doc_id are left out."""
    rank = F.struct(-type_priority(F.col("entity_type")), -F.col("score"), "ord", "entity_type")
    best = F.min(rank).over(Window.partitionBy("doc_id", "surface_lower"))
    return spans.where(F.col("doc_id").isNotNull()).withColumn("label", best["entity_type"])


def _kept(replaces: Callable[[int, int], bool]):
    """The places of the spans that stay, for sorted arrays of starts and ends; one pass.

    A span that begins at or after the last kept end stays; else it takes the last one's place if ``replaces`` (length of
    the last, own length) says so.
    """

    @F.pandas_udf("array<int>")
    def run(starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(a, b) -> list[int]:
            out: list[int] = []
            for i in range(len(a)):
                if not out or a[i] >= b[out[-1]]:
                    out.append(i)
                elif replaces(b[out[-1]] - a[out[-1]], b[i] - a[i]):
                    out[-1] = i
            return out

        return pd.Series([one(a, b) for a, b in zip(starts, ends)])

    return run


def _without_overlaps(spans: DataFrame, order: list[Column], replaces: Callable[[int, int], bool]) -> DataFrame:
    """Each document's spans in ``order`` with overlaps removed; all columns are kept."""
    fields = [c for c in spans.columns if c != "doc_id"]
    sorted_ = F.array_sort(F.collect_list(F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))))
    grouped = spans.groupBy("doc_id").agg(F.transform(sorted_, lambda x: x["row"]).alias("all"))
    at = _kept(replaces)(F.col("all.start"), F.col("all.end"))
    return grouped.select("doc_id", F.inline(F.transform(at, lambda i: F.get("all", i))))


def disjoint_spans(spans: DataFrame) -> DataFrame:
    """Overlaps removed: the earliest start wins, at equal starts the higher score, then the first."""
    return _without_overlaps(spans, [F.col("start"), -F.col("score"), F.col("ord")], lambda last, own: False)


def longest_spans(spans: DataFrame) -> DataFrame:
    """Copies and overlaps removed: a longer span replaces the one before it, others are dropped."""
    first = spans.groupBy("doc_id", "start", "end", "entity_type").agg(F.min(F.struct("ord", "score", "source")).alias("_f"))
    own = first.select("doc_id", "start", "end", "entity_type", F.col("_f.score").alias("score"), F.col("_f.source").alias("source"), F.col("_f.ord").alias("ord"))
    named = F.col("entity_type").isin("PER", "ORG", "LOC")
    rank = F.when(F.col("source") == F.when(named, F.lit("ner")).otherwise(F.lit("regex")), 0).otherwise(1)
    return _without_overlaps(own, [F.col("start"), F.col("start") - F.col("end"), rank, -F.col("score"), F.col("ord")], lambda last, own: own > last)


def block_spans(docs: DataFrame, model: DataFrame, catalog: Iterable[tuple[str, str]] = (), patterns: Iterable[str] = ("EMAIL", "PHONE", "IBAN", "SIREN_SIRET")) -> DataFrame:
    """The union of model spans (gated by score), pattern spans and, last, catalog spans, without copies and overlaps."""
    plain = ["doc_id", *FIELDS, "ord"]
    rows = ner_gate(model).select(*plain).unionByName(spans_of(docs, structured_scan(patterns)).select(*plain).withColumn("ord", F.col("ord") + F.lit(1 << 40)))
    entries = list(catalog)
    if entries:
        rows = rows.unionByName(spans_of(docs, catalog_scan(entries, False, 0.95, "catalog")).select(*plain).withColumn("ord", F.col("ord") + F.lit(1 << 41)))
    return longest_spans(rows)


def numbered_masks(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked texts (doc_id, text) and their spans (doc_id, tag, entity_type, start, end, original).

    Blanks at a span's edges stay in the text, spans of blanks alone are left out; each span gets a tag of its own, numbered
    for each type from the end of the text.
    """
    joined = spans.join(docs.select("doc_id", "text"), "doc_id")
    raw = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    before = F.length(F.regexp_extract(raw, r"(?U)^\s*", 0))
    said = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    tight = joined.select("doc_id", F.upper("entity_type").alias("entity_type"), (F.col("start") + before).alias("start"), said.alias("original"), "ord").where(F.length("original") > 0)
    tagged = backward_tags(tight.withColumn("end", F.col("start") + F.length("original")))
    return spliced(docs, tagged.select("doc_id", "start", "end", F.col("tag").alias("value"))), tagged.select("doc_id", "tag", "entity_type", "start", "end", "original")


def backward_tags(spans: DataFrame) -> DataFrame:
    """Tags ``<TYPE_n>`` numbered for each type from the end of the text, one for each span."""
    n = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy(F.desc("start"), F.desc("ord")))
    return spans.withColumn("tag", F.concat(F.lit("<"), F.col("entity_type"), F.lit("_"), n, F.lit(">")))


def spliced(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, text with each span (doc_id, start, end, value) replaced, from the right to the left; spans are disjoint."""
    spans = replacements.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", "value")))).alias("_spans"))
    put = F.aggregate("_spans", F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["value"], F.substring(t, s["end"] + 1, F.length(t))))
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(put).alias("text"))
