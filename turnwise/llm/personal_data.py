"""Problem 6: personal information inside free text, by weak supervision.

Candidate spans (e-mail forms, digit groups, spelled numbers, street forms, name-like words) are met by labelers: patterns,
gazetteers and contexts, each of which votes for a type, votes against, or abstains.  Expectation-maximisation over the
counts of all vote patterns of the corpus estimates each labeler's reliability per type, without labels.  The resulting
soft labels train a span classifier on shape and context features, which decides every candidate; found spans are
replaced by typed placeholders.

Bounds: vote patterns are counted in Spark, and of the sums only tables of fixed size reach the driver (each labeler has
four values at most, and patterns of a kind below one millionth of all candidates are folded into its silent one);
common words are those with at least 1/10,000 of all words, so at most 10,000; the classifier is fitted on at most
``FIT`` candidates, chosen by hash, and applied to all.

Defined results: null and blank texts hold nothing; a segment delivered twice counts once; of overlapping findings the
longest is masked, names inside e-mail addresses and streets are none; texts of any length are read whole; an empty table
or an empty catalog gives no row, or no gazetteer votes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.segments import one_per_segment
from turnwise.llm.abuse import folded
from turnwise.llm.plain_text import variants
from turnwise.sources.tables import written

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON", "NONE")
NONE = len(TYPES) - 1
#: Candidates that the classifier is fitted on, at most; the buckets of its features.
FIT, BUCKETS = 20_000, 1 << 13
#: A word is common with at least this share of all lower-case words.
COMMON = 1e-4
#: Vote patterns of a smaller share of the candidates are folded into the silent one.
RARE = 1e-6
#: Entries of the catalog that are used, at most; a larger one is refused, since every task gets it.
CATALOG_LIMIT = 200_000

# Words of French and English that the patterns are made of.
_DIGIT_WORDS = "zéro|zero|oh|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|one|two|three|four|five|seven|eight|nine|double|triple"
_NUMBER_WORDS = (
    "un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|trente|quarante|cinquante|soixante|cent|mille|et|"
    "one|two|three|four|five|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|and"
)
_FR_STREET = "rue|avenue|av|boulevard|bd|allée|allee|allées|chemin|impasse|place|quai|route|cours|square|passage|sentier|ruelle|esplanade|faubourg|villa|rond-point"
_EN_STREET = "street|road|lane|close|court|parade|avenue|drive|way|place|square|terrace|crescent|gardens|grove|hill|row|walk|mews|boulevard|highway|st|rd|ave|blvd|ln|dr"
_HONORIFIC = "m|mme|mlle|mr|mrs|ms|miss|dr|docteur|doctor|monsieur|madame|mademoiselle|maître|maitre|me|professor|professeur|prof|sir|lady"
#: Words before a name, which also tell that a common word is one ("my name is will ...").
_INTRODUCES = frozenset("m'appelle appelle name signed signe demandez ask saw vu soeur frere".split())
_HON = frozenset(_HONORIFIC.split("|"))

_AT = r"(?:\s?@\s?|\s?\[\s?at\s?\]\s?|\s?\(\s?at\s?\)\s?|\s+arobase\s+)"
_DOT = r"(?:\.|\s?\[\s?dot\s?\]\s?|\s?\(\s?dot\s?\)\s?|\s+\.\s+|\s+point\s+|\s+dot\s+)"
_JOIN = r"(?:[.\-_+]|\s+(?:point|dot|tiret(?:\s+du\s+bas)?|underscore|dash|plus|moins|hyphen)\s+)"
#: With a sign for at, or the words at and dot.
EMAIL = re.compile(rf"(?i)(?<![\w.+-])[^\W_](?:[\w+-]|{_JOIN}(?=\w))*(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\s+at\s+[\w-]+(?:[.-][\w-]+)*(?:\s+dot\s+[\w-]+)+)")
_EMAIL_PLAIN = re.compile(r"(?i)^[\w.+-]+@[\w-]+(\.[\w-]+)+$")
_GAP = r"(?:[.\-/]|[   ]?[-(][   ]?|\)[   .-]?|[   ])"
DIGITS = re.compile(rf"(?<![\w])(?:(?-i:(?:FR|GB|DE|BE|ES|IT|CH)\d{{2}}(?:[ -]?[A-Z\d]{{4}}){{2,7}}(?:[ -]?[A-Z\d]{{1,3}})?)(?!\w)|(?:FR|GB|DE|BE|ES|IT|CH)[ -]?\d{{2}}(?:[  -]?\d[A-Z]?){{8,30}}(?!\w)|\d{{2}}[A-Z]{{2}}\d{{5}}(?!\w)|(?:\+|00)?\(?\d(?:{_GAP}?\d){{5,}}(?!\w))", re.I)
SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT_WORDS})(?:[\s-]+(?:{_DIGIT_WORDS})){{6,}}(?!\w)")
ADDRESS = re.compile(
    rf"(?i)(?<![\w,.:])(?:(?:flat|apt|apartment|unit|appartement)\s+\w+,?\s+)?(?:\d{{1,4}}(?:\s?(?:bis|ter|quater|[a-d])(?!\w))?|(?!(?:et|and)(?!\w))(?:{_NUMBER_WORDS})(?:[\s-]+(?:{_NUMBER_WORDS}))*),?\s+"
    rf"(?:(?:{_FR_STREET})(?!\w)\s+(?:(?:de|du|des|la|le|les|d'|de\s+l'|l')\s*)*[\w'-]+(?:\s+(?-i:[A-ZÉÈÀÂÎÔÇ][\w'-]+))*|(?:(?!(?:the|a|an|is|in|of|to|dollars|euros|items|points|percent)\s)[a-z][\w'-]*\s+){{1,3}}(?:{_EN_STREET})(?!\w))"
)
_PHONE_LEFT = re.compile(r"(?i)(t[ée]l|phone|portable|mobile|rappele|appele|joindre|call|dial|faites|ring|ligne|reach)\W*(?:\w+\W+){0,4}$")
_PHONE_RIGHT = re.compile(r"(?i)^\s*(?:c'est|is)\s+(?:la|the|ma|my)?\s*(ligne|direct|portable|mobile)")
_ID_LEFT = re.compile(r"(?i)(siren|siret|s[ée]cu|s[ée]curit[ée] sociale|social security|passeport|passport|iban|bank account|compte bancaire|rib|carte d'identit[ée])\W*(?:(?:num[ée]ro|number|no|n°|n)\W*)?$")
_ID_FAR = re.compile(r"(?i)(?<!\w)(?:num[ée]ro|number|facture|invoice|n°)\W*(?:\w+\W+){0,6}$")
_OTHER_LEFT = re.compile(r"(?i)(commande|order|ticket|dossier|version|build|lot|file|batch|fiche|sheet|reste|score|went|en est)\W*(?:\w+\W+){0,2}$")
_OTHER_RIGHT = re.compile(r"(?i)^\W*(?:co[ûu]te|costs?|euros?|dollars?|points?|items?|pour cent|percent|%|[kcm]?[mg](?!\w)|heures?|hours?|minutes?|[ap]\.?m\b)")
_MAIL_CONTEXT = re.compile(r"(?i)(mail|[ée]crire|write|adresse|address|send|envoyez|copie|copy)")
_LIVES = re.compile(r"(?i)(habite|livraison|d[ée]m[ée]nag|venez|live at|parcel|come to|moved to|adresse|address)")
_NAMED_LEFT = re.compile(
    r"(?i)(m'appelle|mon nom est|my name is|sign[ée]d? (?:by|par)|demandez|(?<!\w)ask|(?<!\w)vu|(?<!\w)saw|c'est|s[œo]e?ur de|fr[èe]re de|de la part de|contact(?:ez)?|"
    r"coll[èe]gue|colleague|(?<!\w)amie?|friend|brother|sister|boss|manager|directeur|directrice|director|assistante?|(?:suivi|g[ée]r[ée]|[ée]crit|envoy[ée])e?s? par|(?:led|handled|written|sent) by)\W*(?:à\W+)?$"
)
#: Verbs that mostly have persons as their subject.
_DOES = re.compile(
    r"(?i)^\s+(?:ne\s+|n')?(?:est|a|va|vient|dit|pr[ée]sente|pense|propose|doit|peut|veut|demande|arrive|sera|[ée]tait|avait|habite|travaille|is|has|says|said|was|thinks|wants|asks|asked|comes|came|called|lives|works|wrote|signed)(?!\w)"
)
_PLACE_LEFT = re.compile(r"(?i)(?:(?<!\w)(?:chez|in|at|à|en|de|from|near|to|vers|sur|société|cabinet|company)|\d{5},?)\s+$")
_DETERMINER = re.compile(r"(?i)(?<!\w)(?:le|la|les|un|une|the|a|an|de|du|des|ce|cette|please|i|it|will|en|in|my|this)\s+$")
_ALL_CAPITALS = re.compile(r"^[A-ZÀ-Þ\d-]{2,}$")
_NOTE = re.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*]*\*|[♪♫]+[^♪♫]*[♪♫]+")
_HES = re.compile(r"(?i)^(?:e+u+h+|h+e+u+h*|h+u+m+|h+m+|u+h+m*|u+m+h*|e+r+m*|speaker|spk|locuteur|siren|siret|fr|flat|iban)$")
_TOKEN = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W_])?\.?")
_STREETS = frozenset(folded_word for word in f"{_FR_STREET}|{_EN_STREET}".split("|") for folded_word in (word, folded(word)))
_DIGITS = frozenset(_DIGIT_WORDS.split("|"))
_NUMBERS = frozenset(_NUMBER_WORDS.split("|")) - {"et", "and"}
#: What a token may be part of, as bits.
AT, DIGIT, SPOKEN, NUMBER, STREET, NAME = 1, 2, 4, 8, 16, 32
#: Tokens that a worker remembers, at most.
REMEMBERED = 1_000_000


@cache
def _look_alikes() -> dict[int, str]:
    return {ord(c): plain for c, plain in variants()[0].items()}


def phone_shape(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    plus = s.lstrip(" (").startswith(("+", "00"))
    if plus:
        d = d[2:] if s.lstrip(" (").startswith("00") else d
        return 9 <= len(d) <= 13
    if re.fullmatch(r"0[1-9]\d{8,9}", d):
        return True
    groups = re.findall(r"\d+", s)
    return [len(g) for g in groups] in ([3, 3, 4], [1, 3, 3, 4], [3, 4]) and groups[0][0] != "0"


def id_shape(s: str) -> bool:
    d = re.sub(r"\D", "", s)
    if re.match(r"(?i)[a-z]{2}\s?-?\d{2}", s):
        return len(re.sub(r"\W", "", s)) >= 14
    if re.fullmatch(r"(?i)\d{2}[a-z]{2}\d{5}", s):
        return True
    groups = [len(g) for g in re.findall(r"\d+", s)]
    return len(d) == 15 and d[0] in "12" or len(d) == 14 or groups == [3, 3, 3]


def other_shape(s: str) -> bool:
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:/\d+)?|\d+(?:\.\d+){2,3}|(?:\d{1,2}-\d{1,2}[, ]*)+", s)) and not phone_shape(s)


class Gazetteer:
    """Names of the catalog, folded: whole persons, their words, and words of organisations and places."""

    def __init__(self, rows: list[tuple[str | None, str | None]]) -> None:
        self.full: set[str] = set()
        self.words: Counter[str] = Counter()
        self.other: set[str] = set()
        for pattern, kind in rows:
            words = folded((pattern or "").strip()).split()
            if not words:
                continue
            label = (kind or "").strip().upper()
            if label.startswith("PER"):
                self.full.add(" ".join(sorted(words)))
                self.words.update(words)
            elif label.startswith(("ORG", "LOC", "GPE", "CIT")):
                self.other.update(words)
        # An entry without type adds to the persons only words that typed persons confirm.
        for pattern, kind in rows:
            words = folded((pattern or "").strip()).split()
            if not (kind or "").strip() and words and all(w in self.words for w in words):
                self.full.add(" ".join(sorted(words)))


class Finder:
    """Candidates of a text, with the labelers' votes and the classifier's features."""

    #: Labelers, in the order of their votes.
    LABELERS = ("pattern", "context", "gazetteer", "keyword", "shape", "against", "capitals", "verb")

    def __init__(self, gazetteer: Gazetteer, common: set[str]) -> None:
        self.gazetteer, self.common = gazetteer, common
        self.seen: dict[str, int] = {}

    def signs(self, token: str) -> int:
        """What a text with this token may hold; every pattern's spans have the signs that it is looked for by."""
        word = token.lower().strip(".,;:!?…\"«»'’")
        bare = word.strip("()[]")
        out = AT if "@" in token or "arobase" in word or bare in ("dot", "at", "point") and (bare == "dot" or word != bare) or "[at]" in word or "(at)" in word else 0
        if any(c.isdigit() for c in token):
            out |= DIGIT
        parts = re.split(r"[-']", bare)
        if not _DIGITS.isdisjoint(parts):
            out |= SPOKEN
        if not _NUMBERS.isdisjoint(parts):
            out |= NUMBER
        if not _STREETS.isdisjoint((bare, *parts)):
            out |= STREET
        return out | (NAME if self.is_name_hot(token) else 0)

    def is_name_hot(self, token: str) -> bool:
        """Whether a text with this token needs a closer look for names."""
        word = token.strip(".,;:!?…\"«»()'’")
        if not word or not word[0].isalpha():
            return False
        plain = folded(word)
        if plain in _HON or plain in _INTRODUCES:
            return True
        part = plain.removesuffix("'s").rpartition("'")[2]
        if part in self.gazetteer.words:
            return word[0].isupper() or not self.is_common(part, word)
        return word[0].isupper() and self.name_like(word) and part not in self.gazetteer.other

    def is_common(self, plain: str, word: str) -> bool:
        return plain in self.common or word.lower() in self.common

    def name_like(self, word: str) -> bool:
        """A word that starts like a name and isn't a common word."""
        w = word.strip(".'’")
        low = w.lower()
        return len(w) > 1 and w[0].isupper() and low not in self.common and folded(low) not in self.common and not _HES.match(low) and not any(c.isdigit() for c in w)

    def candidates(self, text: str) -> list[tuple[int, int, str, tuple[int, ...], list[str]]]:
        """(start, end, kind, votes, features) of each candidate span."""
        if not text.isascii() and max(text) > "\u024f":
            text = text.translate(_look_alikes())  # one letter for one, so places stay
        tokens = text.split()
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        signs = 0
        for t in tokens:
            known = seen.get(t)
            if known is None:
                known = seen[t] = self.signs(t)
            signs |= known
        if not signs & (AT | DIGIT | SPOKEN | STREET):
            return self.names(text, []) if signs & NAME else []
        out = []
        taken: list[tuple[int, int]] = []
        free = lambda a, b: all(b <= x or a >= y for x, y in taken)
        low = text.lower()
        if signs & AT:
            for m in EMAIL.finditer(text):
                a, b = m.span()
                s = m.group()
                left, right = text[max(0, a - 40) : a], text[b : b + 30]
                context = _MAIL_CONTEXT.search(left[-25:]) or _MAIL_CONTEXT.search(right[:20])
                plain = _EMAIL_PLAIN.match(s)
                votes = (0, 0 if context else -1, -1, 0 if plain or re.search(r"(?i)arobase|@|\[at\]", s) else -1, 0 if len(s) > 10 else -1, -1, -1, -1)
                out.append(self.row(text, a, b, "email", votes))
                taken.append((a, b))
        if signs & DIGIT and sum(map(str.isdigit, text)) >= 6:
            for m in DIGITS.finditer(text):
                a, b = m.span()
                if free(a, b):
                    out.append(self.row(text, a, b, "digits", self.number_votes(text, a, b)))
                    taken.append((a, b))
        if signs & SPOKEN and sum(1 for t in tokens if seen[t] & SPOKEN) >= 7 or signs & SPOKEN and "-" in text:
            for m in SPELLED.finditer(text):
                a, b = m.span()
                if free(a, b):
                    phone = bool(_PHONE_LEFT.search(text[max(0, a - 40) : a]) or _PHONE_RIGHT.search(text[b : b + 30]))
                    count = len(re.split(r"[\s-]+", m.group())) + len(re.findall(r"(?i)double", m.group()))
                    out.append(self.row(text, a, b, "spelled", (1, 1 if phone else -1, -1, -1, 1 if count >= 9 else NONE, -1, -1, -1)))
                    taken.append((a, b))
        if signs & STREET and signs & (DIGIT | NUMBER):
            for m in ADDRESS.finditer(text):
                a, b = m.span()
                if free(a, b):
                    lives = bool(_LIVES.search(text[max(0, a - 40) : a]))
                    votes = (3, 3 if lives else -1, -1, -1, 3 if text[a].isdigit() or low[a : a + 4] == "flat" else -1, NONE if _OTHER_LEFT.search(text[max(0, a - 30) : a]) else -1, -1, -1)
                    out.append(self.row(text, a, b, "address", votes))
                    taken.append((a, b))
        return out + self.names(text, taken) if signs & NAME else out

    def number_votes(self, text: str, a: int, b: int) -> tuple[int, ...]:
        s, left, right = text[a:b], text[max(0, a - 45) : a], text[b : b + 25]
        phone, ident = phone_shape(s), id_shape(s)
        pattern = 1 if phone and not ident else 2 if ident and not phone else -1
        context = 1 if _PHONE_LEFT.search(left) or _PHONE_RIGHT.search(right) else 2 if _ID_FAR.search(left) else -1
        if any(c.isalpha() for c in s):
            context = 2 if context == 2 else -1  # no phone number has letters
        keyword = 2 if _ID_LEFT.search(left) else -1
        if keyword == 2:
            context = 2
        against = NONE if _OTHER_LEFT.search(left[-25:]) or _OTHER_RIGHT.match(right) else -1
        return (pattern, context, -1, keyword, NONE if other_shape(s) else -1, against, -1, -1)

    def names(self, text: str, taken: list[tuple[int, int]]) -> list[tuple]:
        """Runs of words that look like names or stand in the gazetteer."""
        noted = [m.span() for m in _NOTE.finditer(text)] if any(c in text for c in "[{<*♪") else []
        blocked = taken + noted
        words = []
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            if not any(a < y and b > x for x, y in blocked):
                words.append((a, b, m.group()))
        gaz = self.gazetteer
        out = []
        marks = []
        for a, b, w in words:
            bare = w.rstrip(".")
            if bare.endswith(("'s", "’s")):
                bare, b = bare[:-2], a + len(bare) - 2
            cut = max(bare.rfind("'"), bare.rfind("’")) + 1
            if 0 < cut <= 2:
                a, bare = a + cut, bare[cut:]
            plain = folded(bare)
            known = plain in gaz.words and (bare[0].isupper() or not self.is_common(plain, bare) or bool(_NAMED_LEFT.search(text[max(0, a - 30) : a])))
            initial = len(bare) == 1 and bare.isupper() and w.endswith(".")
            hon = plain in _HON and (bare[0].isupper() or len(plain) > 2) and not initial
            like = self.name_like(bare) and plain not in gaz.other and not hon
            marks.append((a, a + len(bare) + (1 if initial else 0), bare, plain, known, initial, hon, like))
        i = 0
        while i < len(marks):
            a, b, bare, plain, known, initial, hon, like = marks[i]
            starts = known or like or (initial and i + 1 < len(marks) and (marks[i + 1][7] or marks[i + 1][4]) and marks[i + 1][0] - b <= 2)
            if hon or not starts:
                i += 1
                continue
            j = i
            while j + 1 < len(marks) and j - i < 3:
                n = marks[j + 1]
                if text[marks[j][1] : n[0]].strip(" '’") or n[6]:
                    break
                if n[4] or n[7]:
                    j += 1
                elif marks[j][4] and j == i and not bare[0].isupper() and len(n[3]) >= 5 and n[2].islower() and n[2].isalpha() and n[3] not in self.common and n[2] not in self.common:
                    j += 1  # a first name and an unknown word, both written small
                    break
                else:
                    break
            end = marks[j][1]
            first = i - 1 if i and self.leads(text, marks[i - 1], marks[i]) else i
            out.append(self.row(text, marks[first][0], end, "name", self.name_votes(text, marks, first, j)))
            i = j + 1
        return out

    def leads(self, text: str, before: tuple, name: tuple) -> bool:
        """Whether a common word belongs to the name after it: written with a capital though no sentence starts with it."""
        a, b, bare, plain, _, initial, hon, like = before
        capital = len(bare) > 1 and bare[0].isupper() and bare[1:].islower() and not (hon or like or initial)
        return capital and name[0] - b == 1 and name[2][0].isupper() and re.search(r"[^\s.!?…:;>\]})\"«“-]\s+$", text[max(0, a - 10) : a]) is not None

    def name_votes(self, text: str, marks: list[tuple], i: int, j: int) -> tuple[int, ...]:
        a, b = marks[i][0], marks[j][1]
        left, right = text[max(0, a - 30) : a], text[b : b + 30]
        span = marks[i : j + 1]
        plain = [m[3] for m in span]
        upper = all(m[2][0].isupper() for m in span)
        hon = i > 0 and marks[i - 1][6] and a - marks[i - 1][1] <= 2
        if hon:
            left = text[max(0, marks[i - 1][0] - 30) : marks[i - 1][0]]
        full = " ".join(sorted(plain)) in self.gazetteer.full
        known = sum(m[4] for m in span)
        pattern = 4 if len(span) >= 2 and upper and (known or any(m[5] for m in span)) else -1
        context = 4 if _NAMED_LEFT.search(left) else -1
        if len(span) == 1 and not (known and upper) and not hon and context < 0:
            pattern = NONE  # a lone word that nothing introduces
        gazetteer = 4 if full and (len(span) > 1 or upper) else 4 if known and (upper or len(span) > 1) else -1
        keyword = 4 if hon else -1
        common = all(p in self.common or m[2].lower() in self.common for p, m in zip(plain, span))
        if common and len(span) == 1 and span[0][2].isupper():
            gazetteer = -1  # a common word among capitals
        shape = NONE if common and len(span) == 1 and (not upper or span[0][2].isupper()) else 4 if len(span) > 1 and (known or any(m[5] for m in span)) else -1
        against = NONE if _PLACE_LEFT.search(left) and not context == 4 or (_DETERMINER.search(left) and len(span) == 1 and not upper) else -1
        capitals = 4 if len(span) >= 2 and upper and all(len(m[2]) > 1 for m in span) else NONE if len(span) == 1 and bool(_ALL_CAPITALS.match(span[0][2])) else -1
        verb = 4 if _DOES.match(right) else -1
        return (pattern, context, gazetteer, keyword, shape, against, capitals, verb)

    def row(self, text: str, a: int, b: int, kind: str, votes: tuple[int, ...]) -> tuple:
        left = re.findall(r"[^\W\d_]+|\d|@", text[max(0, a - 30) : a].lower())[-3:]
        right = re.findall(r"[^\W\d_]+|\d|@", text[b : b + 30].lower())[:2]
        s = text[a:b]
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zà-ÿœ]", "x", re.sub(r"[A-ZÀ-Þ]", "X", re.sub(r"\d", "9", s))))[:12]
        digits = sum(c.isdigit() for c in s)
        feats = [f"k{kind}", f"s{kind}{shape}", f"d{kind}{digits}", f"v{kind}{votes}"] + [f"l{kind}{k}{w}" for k, w in enumerate(reversed(left))] + [f"r{kind}{k}{w}" for k, w in enumerate(right)]
        feats += [f"p{kind}{n}{v}" for n, v in enumerate(votes)]
        return a, b, kind, votes, feats


def bucket(feature: str) -> int:
    """A stable bucket of a feature (Python's own hash differs between workers)."""
    h = 2166136261
    for c in feature.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


_buckets: dict[str, int] = {}


def buckets_of(feats: list[str]) -> list[int]:
    out = []
    for f in feats:
        k = _buckets.get(f)
        if k is None:
            if len(_buckets) > 1_000_000:
                _buckets.clear()
            k = _buckets[f] = bucket(f)
        out.append(k)
    return out


def common_words(segments: DataFrame, share: float = COMMON) -> set[str]:
    """Lower-case words with at least ``share`` of all of them (so at most 1 / share words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            tokens = pc.utf8_split_whitespace(batch.column(0).drop_null()).flatten().value_counts()
            for token, n in zip(tokens.field(0).to_pylist(), tokens.field(1).to_pylist()):
                total[token] += n
            if len(total) > 500_000:
                yield rows(total)
                total = Counter()
        yield rows(total)

    def rows(total: Counter[str]) -> pa.RecordBatch:
        own: Counter[str] = Counter()
        for token, n in total.items():
            for word in re.split(r"['’]", token.strip(".,;:!?…\"«»()[]{}<>*♪-")):
                if word.isalpha() and word.islower():
                    own[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    counts = segments.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"] for r in counts.where(F.col("n") >= share * total).select("word").collect()}  # at most 1 / share rows


def catalog_rows(catalog: DataFrame) -> list[tuple[str | None, str | None]]:
    rows = catalog.select("pattern", "entity_type").distinct().limit(CATALOG_LIMIT + 1).collect()
    if len(rows) > CATALOG_LIMIT:
        raise ValueError(f"the catalog has more than {CATALOG_LIMIT} entries")
    return [tuple(r) for r in rows]


KINDS = ("email", "digits", "spelled", "address", "name")
CANDIDATE = "rec_id bigint, seg_idx bigint, `from` int, `to` int, kind int, votes string, feats array<int>"


def find_candidates(segments: DataFrame, finder: Finder) -> DataFrame:
    """Every candidate span of every segment, with its votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            recs, segs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    for a, b, kind, votes, feats in finder.candidates(text):
                        rows.append((recs[k], segs[k], a, b, KINDS.index(kind), ",".join(map(str, votes)), buckets_of(feats)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["rec_id", "seg_idx", "from", "to", "kind", "votes", "feats"])

    known = segments.select("rec_id", "seg_idx", "text").where(F.col("rec_id").isNotNull() & F.col("seg_idx").isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(run, CANDIDATE)


#: Types that a kind of candidate can have.
POSSIBLE = {0: (0, NONE), 1: (1, 2, NONE), 2: (1, NONE), 3: (3, NONE), 4: (4, NONE)}


def label_model(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, tuple[int, ...]], np.ndarray]:
    """Soft types of vote patterns (kind, votes, count) by expectation-maximisation.

    A labeler's chance to cast each vote, given kind and true type, is estimated together with the types' shares.  A prior
    worth a fifth of the candidates says that labelers are mostly right or silent, which keeps the types from changing places.
    """
    out: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}
    for kind, types in POSSIBLE.items():
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        votes = np.array([v for v, _ in own])
        n = np.array([c for _, c in own], float)
        # Start: the share of the votes cast, with a little doubt.
        post = np.full((len(own), len(types)), 0.2)
        for j, t in enumerate(types):
            post[:, j] += (votes == t).sum(axis=1)
        post /= post.sum(axis=1, keepdims=True)
        values = [-1, *types]
        prior = {(t, v): (0.45 if v in (t, -1) else 0.1 / (len(types) - 1)) * (0.2 * n.sum() + 5) for t in types for v in values}
        weight = 0.2 * n.sum() + 5
        for _ in range(rounds):
            share = (n[:, None] * post).sum(axis=0) + 1.0
            log = np.log(share / share.sum())[None, :].repeat(len(own), axis=0)
            for labeler in range(votes.shape[1]):
                for value in values:
                    mine = votes[:, labeler] == value
                    chance = ((n * mine)[:, None] * post).sum(axis=0) + [prior[t, value] for t in types]
                    log[mine] += np.log(chance / (share + weight))
            post = np.exp(log - log.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
        for (v, _), p in zip(own, post):
            full = np.zeros(len(TYPES))
            full[list(types)] = p
            out[kind, tuple(v)] = full
    return out


def fit_classifier(feats: list[list[int]], soft: np.ndarray, rounds: int = 40, rate: float = 0.5) -> np.ndarray:
    """Weights of a softmax over hashed features, fitted to soft types by AdaGrad on mini-batches."""
    w = np.zeros((BUCKETS, len(TYPES)))
    g2 = np.full_like(w, 1e-3)
    rng = np.random.default_rng(6)
    lengths = np.array([len(f) for f in feats])
    flat, first = np.concatenate([np.asarray(f) for f in feats]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for _ in range(rounds):
        order = rng.permutation(len(feats))
        for k in range(0, len(order), 512):
            rows = order[k : k + 512]
            at = np.concatenate([flat[first[r] : first[r] + lengths[r]] for r in rows])
            of = np.repeat(np.arange(len(rows)), lengths[rows])
            z = np.zeros((len(rows), len(TYPES)))
            np.add.at(z, of, w[at])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - soft[rows]) / len(rows)
            g = np.zeros_like(w)
            np.add.at(g, at, d[of])
            g += 1e-6 * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return w


def trained(candidates: DataFrame) -> np.ndarray:
    """The span classifier's weights, from the vote patterns of all candidates."""
    counts = candidates.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = [(r["kind"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in counts.collect()]  # labelers' values have a fixed number of patterns
    total = sum(n for _, _, n in patterns)
    if not total:
        return np.zeros((BUCKETS, len(TYPES)))
    silent = (-1,) * len(Finder.LABELERS)
    folded_counts: Counter = Counter()
    for kind, votes, n in patterns:
        folded_counts[kind, votes if n >= RARE * total else silent] += n
    soft = label_model([(kind, votes, n) for (kind, votes), n in folded_counts.items()])
    soft |= {(kind, votes): soft[kind, silent] for kind, votes, n in patterns if n < RARE * total}
    share = min(1.0, FIT / total)
    chosen = candidates.where(F.pmod(F.xxhash64("rec_id", "seg_idx", "from"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    rows = chosen.select("kind", "votes", "feats").limit(2 * FIT).collect()  # FIT rows on average
    if not rows:
        return np.zeros((BUCKETS, len(TYPES)))
    target = np.array([soft[r["kind"], tuple(map(int, r["votes"].split(",")))] for r in rows])
    return fit_classifier([r["feats"] for r in rows], target)


def decide(kind: int, feats: list[int], weights: np.ndarray) -> int:
    """The type of a candidate: the likeliest of those its kind can have."""
    z = weights[feats].sum(axis=0)
    return max(POSSIBLE[kind], key=lambda t: z[t])


def _model(segments: DataFrame, catalog: DataFrame) -> tuple[Finder, DataFrame, np.ndarray]:
    finder = Finder(Gazetteer(catalog_rows(catalog)), common_words(segments))
    candidates = written(find_candidates(segments, finder), "candidates")
    return finder, candidates, trained(candidates)


def found_types(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """rec_id, seg_idx, pii_type: the types found in each segment."""
    _, candidates, weights = _model(segments, catalog)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(2).to_pylist()
            got = np.array([decide(k, f, weights) for k, f in zip(kinds, batch.column(3).to_pylist())], np.int64)
            keep = np.flatnonzero(got != NONE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array([TYPES[t] for t in got[keep]], pa.string())], ["rec_id", "seg_idx", "pii_type"])

    return candidates.select("rec_id", "seg_idx", "kind", "feats").mapInArrow(run, "rec_id bigint, seg_idx bigint, pii_type string").distinct()


def masked_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder in place of each span; of overlapping spans the longest, then the first."""
    chosen: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(b <= x or a >= y for x, y, _ in chosen):
            chosen.append((a, b, kind))
    out, last = [], 0
    for a, b, kind in sorted(chosen):
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, text[last:]])


def masked_segments(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """rec_id, seg_idx, masked: the text of every segment with typed placeholders, null where it is null.

    A segment delivered twice gives one row; the candidates found for the model are used again, texts are read once more.
    """
    own = one_per_segment(segments.select("rec_id", "seg_idx", "text", *[c for c in ("arrived_at",) if c in segments.columns]), ["text"])
    _, candidates, weights = _model(own, catalog)

    @F.pandas_udf("string")
    def decided(kinds: pd.Series, feats: pd.Series) -> pd.Series:
        return pd.Series([TYPES[decide(int(k), f, weights)] for k, f in zip(kinds, feats)], dtype=object)

    @F.pandas_udf("string")
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else masked_text(t, [(s["from"], s["to"], s["pii_type"]) for s in x]) for t, x in zip(texts, spans)], dtype=object)

    found = candidates.select("rec_id", "seg_idx", "from", "to", decided("kind", "feats").alias("pii_type")).where(F.col("pii_type") != TYPES[NONE])
    spans = found.groupBy("rec_id", "seg_idx").agg(F.collect_list(F.struct("from", "to", "pii_type")).alias("spans"))
    return own.join(spans, ["rec_id", "seg_idx"], "left").select("rec_id", "seg_idx", put("text", "spans").alias("masked"))
