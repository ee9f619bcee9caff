"""Entities from mentions: greedy grouping of close surfaces, canonical forms, tags, statistics, merging of mappings.

Grouping depends on the order of mentions, so it runs on one document's mentions of one type at a time, after equal
surfaces have been reduced to one row each.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.similarity import reaches, token_set_ratio, token_sort_ratio

_SPECIAL = str.maketrans({"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "Œ": "OE", "Æ": "AE", "Ø": "O"})


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_SPECIAL)) if not unicodedata.combining(c))


_PART = re.compile(r"[a-z0-9]+")


@lru_cache(1 << 15)
def keys(surface: str) -> tuple[str, str]:
    """What a surface is compared by: its runs of plain small letters and digits, joined and spaced."""
    parts = _PART.findall(plain(surface.lower()))
    return "".join(parts), " ".join(parts)


@lru_cache(1 << 17)  # names and places are the same in most documents
def close(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether two keys are one entity's: equal, alike by 92, or alike by 80 with one initial and nearly one length."""
    if not a[0] or not b[0]:
        return False
    if a[0] == b[0]:
        return True
    least = 80 if a[0][0] == b[0][0] and abs(len(a[0]) - len(b[0])) <= 3 else 92
    if reaches(a[0], b[0], least):
        return True
    # Two single words: both token ratios are the plain one.
    return (" " in a[1] or " " in b[1]) and (token_set_ratio(a[1], b[1]) >= least or token_sort_ratio(a[1], b[1]) >= least)


#: Groups from which on ``Nearby`` looks before ``close``; below it would not pay. Letters and words of a key that it has columns for.
MANY, LETTERS, WORDS = 48, 64, 8
_CODES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}
_NONE = len(_CODES)


class Nearby:
    """The keys of many groups in columns, to tell at once all those that a key can be close to.

    It only rules out what no ratio of ``close`` can reach: by the letters that two keys share, then by their longest
    common subsequence (joined, and in the order of words), with the words they share; keys that repeat a word or don't fit
    the columns are let through.
    """

    def __init__(self) -> None:
        self.room = 256
        self.words: dict[str, int] = {}
        self.tables = {
            "counts": np.zeros((_NONE - 1, self.room), np.int16), "joined": np.full((LETTERS, self.room), _NONE, np.uint8), "sorted": np.full((LETTERS, self.room), _NONE, np.uint8), "words": np.zeros((WORDS, self.room), np.int32),
            "size": np.zeros((1, self.room), np.int32), "least": np.zeros((1, self.room), np.int32), "blanks": np.zeros((1, self.room), np.int32), "initial": np.zeros((1, self.room), np.uint8), "odd": np.zeros((1, self.room), bool),
        }

    def put(self, at: int, key: tuple[str, str]) -> None:
        """Group ``at`` has ``key`` from now on."""
        if at >= self.room:
            self.tables = {k: np.concatenate([t, np.full_like(t, _NONE if k in ("joined", "sorted") else 0)], axis=1) for k, t in self.tables.items()}
            self.room *= 2
        joined, words = key[0], sorted(key[1].split())
        ordered, blanks = " ".join(words), max(0, len(words) - 1)
        t = self.tables
        for table in ("counts", "words"):
            t[table][:, at] = 0
        for c in set(joined):
            t["counts"][_CODES[c], at] = min(joined.count(c), 30_000)
        for name, text in (("joined", joined), ("sorted", ordered)):
            t[name][:, at] = [*[_CODES[c] for c in text[:LETTERS]], *[_NONE] * (LETTERS - len(text))]
        for n, word in enumerate(words[:WORDS]):
            t["words"][n, at] = self.words.setdefault(word, len(self.words) + 1)
        t["size"][0, at], t["blanks"][0, at], t["initial"][0, at] = len(joined), blanks, _CODES[joined[0]] if joined else _NONE
        t["least"][0, at] = min(len(joined), len(" ".join(set(words))))
        t["odd"][0, at] = len(ordered) > LETTERS or len(words) > WORDS or len(set(words)) < len(words)

    def able(self, key: tuple[str, str], lo: int, hi: int) -> list[int]:
        """The groups from ``lo`` to ``hi`` that ``key`` may be close to, in order."""
        joined, words = key[0], sorted(key[1].split())
        if not joined:
            return []
        ordered, blanks = " ".join(words), len(words) - 1
        t = self.tables
        one = lambda name: t[name][0, lo:hi]
        near = (one("initial") == _CODES[joined[0]]) & (np.abs(one("size") - len(joined)) <= 3)
        least = np.where(near, 80, 92)
        shared = np.minimum(one("blanks"), blanks)
        for c in set(joined):
            shared += np.minimum(t["counts"][_CODES[c], lo:hi], joined.count(c))
        at = np.flatnonzero(shared * (200 - least) >= least * np.minimum(one("least"), min(len(joined), len(" ".join(set(words))))))
        if len(ordered) > LETTERS or len(words) > WORDS or len(set(words)) < len(words) or not len(at):
            return (at + lo).tolist()
        shared, at, least = shared[at], at + lo, least[at]
        size, several = t["size"][0, at], t["blanks"][0, at] + blanks
        kept = t["odd"][0, at] | (self.common("joined", joined, at) * (200 - least) >= least * np.minimum(size, len(joined)))
        some = np.flatnonzero((several > 0) & ~kept)
        if len(some):
            of, least, whole = at[some], least[some], size[some] + t["blanks"][0, at[some]]
            both = np.full(len(some), -1)  # the length of the common words
            for word in words:
                if n := self.words.get(word):
                    both += (t["words"][:, of] == n).any(axis=0) * (len(word) + 1)
            # With common words a sequence is theirs and the others' at most; theirs alone is a part of each side.
            word_set = (both > 0) & ((200 * shared[some] >= least * (whole + len(ordered))) | (200 * both >= least * (both + np.minimum(whole, len(ordered)))))
            kept[some] = word_set | (200 * self.common("sorted", ordered, of) >= least * (whole + len(ordered)))
        return at[kept].tolist()

    def common(self, table: str, text: str, at: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of ``text`` and each of the groups ``at``, all columns of bits at once."""
        places = np.zeros(_NONE + 1, np.uint64)
        for i, c in enumerate(text):
            places[_CODES[c]] |= np.uint64(1 << i)
        longest = int((self.tables["size"][0, at] + self.tables["blanks"][0, at]).max())
        rows = np.uint64((1 << len(text)) - 1)
        state, total = np.full(len(at), rows), np.empty(len(at), np.uint64)
        for hit in places[self.tables[table][: min(longest, LETTERS), at]]:
            hit &= state
            np.add(state, hit, out=total)
            state ^= hit
            state |= total
        return len(text) - np.bitwise_count(state & rows).astype(np.int32)


def presented(surface: str, label: str, domain: dict[str, str] | None = None) -> str:
    """A surface as it is shown: the domain's own form where it has one (``domain``: by small letters); persons without
    accents and capitalised (short acronyms stay); organisations and places written small titled."""
    clean = " ".join(surface.split())
    if domain and (own := domain.get(clean.lower())):
        return own
    if label == "PERSON":
        words = [plain(w) for w in clean.split()]
        return " ".join(w if w.isupper() and len(w) <= 4 else w[:1].upper() + w[1:].lower() for w in words)
    return clean.title() if label in ("ORGANIZATION", "LOCATION") and clean.islower() else clean


def quality(surface: str) -> tuple[int, int, int, int]:
    """How well a surface is written: capitalised words, words, case (mixed 1, one case 0, no letters -1), length."""
    words = surface.split()
    cases = (surface != surface.lower()) + (surface != surface.upper())
    return sum(w[:1] != w[:1].lower() for w in words), len(words), cases - 1, len(surface.strip())


@dataclass
class Group:
    canonical: str
    score: float
    source: str
    first: int
    key: tuple[str, str]
    surfaces: list[str] = field(default_factory=list)

    def add(self, surface: str, score: float, source: str, label: str, domain: dict[str, str] | None = None) -> None:
        self.surfaces.append(surface)
        shown = presented(surface, label, domain)
        if shown and self.yields(shown, score, label, domain or {}):
            self.canonical, self.key = shown, keys(shown)
        if score > self.score:
            self.score, self.source = score, source

    def yields(self, shown: str, score: float, label: str, domain: dict[str, str]) -> bool:
        """Whether the canonical form gives way to ``shown``: domain forms first, then a person's singular, the score, the form."""
        if shown.lower() in domain or self.canonical.lower() in domain:
            return shown.lower() in domain
        mine, other = self.key[0], keys(shown)[0]
        if label == "PERSON" and mine != other and other == mine.rstrip("s"):
            return True
        if label == "PERSON" and mine != other and mine == other.rstrip("s"):
            return False
        if abs(score - self.score) > 0.05:
            return score > self.score
        return quality(shown) > quality(self.canonical)


def group_mentions(mentions: list[tuple[int, str, float, str]], label: str, domain: dict[str, str] | None = None) -> list[Group]:
    """Mentions (place, surface, score, source) of one type in text order, each put to the first group that is close.

    A surface met before is close to the first group that had been close to it, unless that or an earlier group has a new
    canonical form since; only then are groups compared again.
    """
    groups: list[Group] = []
    nearby: Nearby | None = None
    met: dict[tuple[str, str], tuple[int, int]] = {}
    changes = 0

    def first_close(key: tuple[str, str]) -> int:
        if nearby is None:
            return next((i for i, g in enumerate(groups) if close(g.key, key)), -1)
        lo, hi = 0, 512
        while lo < len(groups):
            for i in nearby.able(key, lo, min(hi, len(groups))):
                if close(groups[i].key, key):
                    return i
            lo, hi = hi, 4 * hi
        return -1

    for place, surface, score, source in mentions:
        key = keys(surface)
        known = met.get(key)
        if known and known[1] == changes:
            at = known[0]
        else:
            at = first_close(key)
        if at < 0:
            shown = presented(surface, label, domain)
            groups.append(Group(shown, score, source, place, keys(shown), [surface]))
            at = len(groups) - 1
            if nearby:
                nearby.put(at, groups[at].key)
            elif len(groups) >= MANY:
                nearby = Nearby()
                for i, g in enumerate(groups):
                    nearby.put(i, g.key)
            if not close(groups[at].key, key):
                continue
        else:
            before = groups[at].key
            groups[at].add(surface, score, source, label, domain)
            if groups[at].key != before:
                changes += 1
                if nearby:
                    nearby.put(at, groups[at].key)
        met[key] = at, changes
    return groups


GROUPED = "array<struct<entity:int,canonical:string,surface:string,first_pos:bigint,score:double,source:string>>"


def entity_clusters(mentions: DataFrame, domain: dict[str, str] | None = None) -> DataFrame:
    """Mentions (doc_id, start, surface, label, score, source) grouped: doc_id, label, entity (from 1, by first
    appearance), tag, canonical, surface, first_pos, score, source.

    ``domain``: the catalog's forms by their small letters (bounded by the catalog's limit); such a form stays canonical.
    """

    @F.pandas_udf(GROUPED)
    def grouped(label: pd.Series, mentions: pd.Series) -> pd.Series:
        def one(kind: str, rows) -> list[dict]:
            found = group_mentions([(r["start"], r["surface"], r["score"], r["source"]) for r in rows], kind, domain)
            return [
                {"entity": n, "canonical": g.canonical, "surface": s, "first_pos": g.first, "score": g.score, "source": g.source}
                for n, g in enumerate(found, 1) for s in dict.fromkeys(g.surfaces)
            ]

        return pd.Series([one(k, rows) for k, rows in zip(label, mentions)])

    first = mentions.groupBy("doc_id", "label", "surface").agg(F.min("start").cast("long").alias("start"), F.max("score").alias("score"), F.max_by("source", "score").alias("source"))
    ordered = first.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(F.struct("start", "surface", "score", "source"))).alias("mentions"))
    found = ordered.select("doc_id", "label", F.inline(grouped("label", "mentions")))
    return found.withColumn("tag", F.concat(F.lit("<"), "label", F.lit("_"), "entity", F.lit(">")))


def tag_mapping(spans: DataFrame) -> DataFrame:
    """doc_id, tag, type, canonical (the longest mention, the first among equals), mentions, sources, score_avg."""
    mention = F.trim("surface")
    own = spans.where(F.length(mention) > 0).select("doc_id", "tag", F.col("entity_type").alias("type"), "start", mention.alias("mention"), "source", "score")
    rows = own.groupBy("doc_id", "tag", "type").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "mention"))), lambda x: x["mention"])).alias("mentions"),
        F.min(F.struct((-F.length("mention")).alias("l"), "start", "mention")).alias("_best"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.round(F.avg("score"), 4).alias("score_avg"),
    )
    return rows.select("doc_id", "tag", "type", F.col("_best.mention").alias("canonical"), "mentions", "sources", "score_avg")


def entity_stats(tagged: DataFrame) -> DataFrame:
    """doc_id, type, n_mentions (all spans), n_entities (distinct tags)."""
    return tagged.groupBy("doc_id", F.col("entity_type").alias("type")).agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("tag").alias("n_entities"))


def merged_mappings(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two mappings (scope, tag, label, canonical) as one: an extra tag that collides gets its label's next number.

    Result: scope, tag, label, canonical, old_tag (the extra's own tag, null for the base).
    """
    number = F.coalesce(F.regexp_extract("tag", r"<\s*[A-Za-z_]+_(\d+)\s*>", 1).try_cast("int"), F.lit(0))
    most = base.unionByName(extra).groupBy("scope", "label").agg(F.max(number).alias("_most"))
    taken = base.select("scope", "tag", F.lit(True).alias("_taken")).distinct()
    marked = extra.join(taken, ["scope", "tag"], "left").join(most, ["scope", "label"])
    again = F.row_number().over(Window.partitionBy("scope", "label", "_taken").orderBy(number, "tag"))
    renamed = F.when(F.col("_taken"), F.concat(F.lit("<"), "label", F.lit("_"), F.col("_most") + again, F.lit(">"))).otherwise(F.col("tag"))
    new = marked.select("scope", renamed.alias("tag"), "label", "canonical", F.col("tag").alias("old_tag"))
    return base.select("scope", "tag", "label", "canonical", F.lit(None).cast("string").alias("old_tag")).unionByName(new)


def merged_lookups(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two lookups (scope, key, value) as one: of equal keys the base's value stands."""
    rows = base.select("scope", "key", "value", F.lit(0).alias("_side")).unionByName(extra.select("scope", "key", "value", F.lit(1).alias("_side")))
    return rows.groupBy("scope", "key").agg(F.min(F.struct("_side", "value"))["value"].alias("value"))


def merged_stats(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two counts (scope, label, n) as one, summed, with the scope's total."""
    both = base.select("scope", "label", "n").unionByName(extra.select("scope", "label", "n")).groupBy("scope", "label").agg(F.sum("n").alias("n"))
    total = both.groupBy("scope").agg(F.sum("n").alias("total"))
    return both.join(total, "scope")


def restored(docs: DataFrame, lookup: DataFrame, tolerant: bool = True) -> DataFrame:
    """doc_id, text with each key (doc_id, key, value) put back in one pass, longest key first, at word boundaries.

    With ``tolerant`` a second pass puts back keys of words that came back in another case, with other accents, or, for
    organisations, without their last word.
    """

    @F.pandas_udf("string")
    def put(text: pd.Series, names: pd.Series, values: pd.Series) -> pd.Series:
        def one(t: str | None, n, v) -> str | None:
            if t is None or n is None or not len(n):
                return t
            table = dict(zip(n, v))
            edge = lambda k: (r"(?<!\w)" if k[:1].isalnum() else "") + re.escape(k) + (r"(?!\w)" if k[-1:].isalnum() else "")
            exact = re.compile("|".join(edge(k) for k in sorted(table, key=lambda k: (-len(k), k))))
            # What the first pass put back is final: the second reads only what lies between.
            out, last = [], 0
            for m in exact.finditer(t):
                out += [restored_tolerantly(t[last : m.start()], table) if tolerant else t[last : m.start()], table[m.group()]]
                last = m.end()
            return "".join([*out, restored_tolerantly(t[last:], table) if tolerant else t[last:]])

        return pd.Series([one(*x) for x in zip(text, names, values)], dtype=object)

    own = lookup.where(F.length("key") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("_all"))
    joined = docs.select("doc_id", "text").join(own, "doc_id", "left")
    pick = lambda name: F.transform("_all", lambda x: x[name])
    return joined.select("doc_id", put("text", pick("key"), pick("value")).alias("text"))


def restored_in_order(text: Column, pairs: Column) -> Column:
    """``text`` with pairs (key, value) of an array replaced one after another, longest key first."""
    ordered = F.array_sort(pairs, lambda a, b: F.when(F.length(a["key"]) > F.length(b["key"]), -1).when(F.length(a["key"]) < F.length(b["key"]), 1).otherwise(0))
    return F.aggregate(ordered, text, lambda t, p: F.replace(t, p["key"], p["value"]))


_ACCENTED = {"a": "aàáâãä", "c": "cç", "e": "eèéêë", "i": "iìíîï", "n": "nñ", "o": "oòóôõö", "u": "uùúûü", "y": "yýÿ"}


#: Last words of organisations that may be left out (fixed values).
SUFFIXES = frozenset("Conseil Legal Services Industries Groupe Solutions Partners Associates Collectif Studio".split())


def without_suffix(name: str) -> str | None:
    """An organisation's name without its last word, if that is one of the usual ones and others remain."""
    head, _, last = " ".join(name.split()).rpartition(" ")
    return head if head and last.strip(",.;:") in SUFFIXES else None


def label_of_tag(tag: Column) -> Column:
    """The label of ``<LABEL_n>``, empty for anything else."""
    return F.coalesce(F.regexp_extract(tag, r"^<([A-Z_]+)_\d+>", 1), F.lit(""))


def tolerant_pattern(key: str) -> str:
    """A key of words in any case and with any accents, blanks of any kind between, at word boundaries."""
    letter = lambda c: f"[{_ACCENTED[c]}]" if c in _ACCENTED else r"\s+" if c == " " else "['’]" if c in "'’" else re.escape(c)
    return r"(?<!\w)" + "".join(map(letter, plain(" ".join(key.lower().split())))) + r"(?!\w)"


def restored_tolerantly(text: str | None, table: dict[str, str]) -> str | None:
    """A second pass for keys of words that came back in another case, with other accents or without a usual last word.

    Replacements are literal, and only whole words are replaced; keys with digits or tag signs take no part, and a key
    without its last word only where no other key has that form.
    """
    if not text:
        return text
    form = lambda k: plain(" ".join(k.lower().replace("’", "'").split()))
    worded = {k: v for k, v in sorted(table.items()) if len(k) >= 3 and re.fullmatch(r"[^\W\d_](?:[^\W\d_]|['’\s-])*", k)}
    names = {form(k): v for k, v in worded.items()}
    short = {}
    for k, v in worded.items():
        if (head := without_suffix(k)) and len(head) >= 3:
            short.setdefault(form(head), v)
    names = short | names
    if not names:
        return text
    pattern = re.compile("|".join(tolerant_pattern(k) for k in sorted(names, key=lambda k: (-len(k), k))), re.I)
    return pattern.sub(lambda m: names.get(form(m.group()), m.group()), text)


def mapping_rows(mapping: Column) -> Column:
    """A mapping tag -> struct as an array of (tag, entity), in the order of tags."""
    return F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("tag"), e["value"].alias("entity"))))
