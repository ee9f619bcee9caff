"""Problem 9: abusive, hateful or sexual content.

A lexicon of terms by kind (insults, dismissals, threats, dehumanizing words, calls for violence, sexual words, ...) is one
trie.  A Levenshtein automaton is intersected with it, so that misspelled and masked terms are met
while a token is read once: masks stand for any letter, digits and signs that look like a letter cost nothing, repeated
letters collapse.  The product is made deterministic lazily and kept by each Python worker.  Terms alone decide nothing:
each sentence around a hit gets a score from the kinds that meet in its context window, and groups are told by the frame
they stand in, not by their names; technical company (a bastard file, a slave cylinder, a male connector), talk about a
word and reported speech in quotation marks lower it.

Defined results: null and blank texts score 0; a document's score is that of its worst sentence, in [0, 1]; texts are
read whole, of any length; repeated rows and further columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.plain_text import variants

# The lexicon, by kind.  A term of several words is met word by word.
LEXICON = {
    # words that are insults wherever they stand
    "slur": "asshole arsehole dickhead scumbag shithead motherfucker wanker bitch cunt whore slut sluts twat prick arschloch drecksack schwachkopf hurensohn wichser mistkerl miststück dreckspack "
    "gilipollas cabrón cabron hijoputa malparido pendejo enculé encule enculée connard connasse salaud salope salopes schlampe schlampen hure huren putas schwuchtel pute pétasse fdp bâtard crétin",
    # words that insult when they are aimed at somebody
    "insult": "idiot idiots moron morons imbecile imbecil imbécil retard retarded bastard bastards stupid pathetic worthless disgusting loser fool scum trottel depp vollidiot blöder dumme dummer débile maldito foutre abruti imbécile "
    "idiota subnormal estúpido tonto puta puto basura piece shit mierda merde ordure blöde mistgeburt pauvre sale perra zorra zorras cerdo penner versager",
    # sending people away, wishing them harm; the second kind counts only beside the first
    "away": "fuck shut hell verpiss verreck fresse gueule dégage vete cállate callate muérete muerete piérdete lárgate largate hau crève creve nique fous",
    "push": "drop dead lost die rot eat choke espèce va casse ferme halt stirb go geh",
    # harm announced, and who announces it
    "threat": "kill murder strangle stab shoot hurt beat burn tuer buter égorger étrangler frapper töten toten umbringen abstechen erschießen erschlagen matar degollar apuñalar golpear",
    "self": "i i'll we we'll je on nous ich wir yo voy vamos nosotros will gonna vais werde werden",
    # the person spoken to
    "weak": "con conne cons fils hijo hija gros pauvre espèce",
    "you": "you your yourself du dich dir dein tu te toi t'es eres tú ti tus vous ihr fucking",
    "crowd": "nobody niemand nadie personne wants want will quiere veut here hier aquí aqui ici",
    "writer": "whoever wrote only complete like such rubbish wer schrieb quien escribió escribio celui écrit qu'un",
    # groups of people, by common words only; the names of peoples are told by their endings and by the frame they stand in
    "group": "foreigners foreigner immigrants immigrant refugees refugee migrants people étrangers etrangers immigrés immigres réfugiés refugies gens ausländer "
    "auslander flüchtlinge fluchtlinge einwanderer leute extranjeros inmigrantes refugiados gente muslims jews gypsies women",
    # what people are called: words that demean by themselves, and words of biology and medicine that need more company
    "dehuman": "vermin rapists thieves subhuman filthy scum ungeziefer abschaum diebe vergewaltiger untermenschen ladrones violadores vermine voleurs violeurs dreckspack racaille nuisibles escoria",
    "creature": "animals parasites parasite disease cattle rats cockroaches parasiten tiere parasit krankheit parásitos parasitos animales plaga ratas enfermedad animaux maladie rats bestias plague pest",
    "copula": "are is be were sind ist seid sein sont est êtes être son es eres sois ser they",
    # what should be done to them: violence, and what may be done to things too
    "expel": "raus fuera dehors weg out",
    "these": "those diesem diese diesen ces cette estos esos",
    "harm": "wiped deported shot cage hanged gassed expulser pendre expulsados echarlos exterminarlos exterminar expulsar matar vergasen erschossen hängen eingesperrt gehängt tuer fusiler enfermer "
    "echar ausgerottet jaula cage sea meer mer mar dead toter mort muerto deport fusilados exterminés gagné",
    "remove": "rid belongs lets country decent every only good raus fuera dehors weg gehören gehoren verschwinden éliminer eliminer jeter moins menos less eliminarlos out should must faut hay deben müssen sollen sollten",
    # sexual words
    "porn": "porn porno pornovideo uncensored",
    "sexual": "sex sexo sexe fuck suck lick pleasure moaned rode cock pussy tits cum ficken blasen geleckt lecken geil stöhnte ritt lécher lecher sucer baiser gémit gemit chevauchait chupar follar lamer gemía gemia "
    "montaba calientes",
    "bare": "naked half-naked nackt nackte nackten nues nue desnudas desnuda desnudos underwear panties bra lingerie slip culotte slips bragas tanga braguitas sujetador dessous höschen hoschen soutien-gorge poil",
    "bodies": "women woman housewives blondes teens girls ladies neighbours frauen hausfrauen blondinen mädchen madchen nachbarinnen femmes voisines filles blondes mujeres amas vecinas rubias chicas her him she he elle sie ella tonight nacht soir noche hot camera",
    "undress": "took off begged enleva supplia zog aus quitó quito rogó rogo floor boden suelo suplicó suplico",
    # technical company
    "technical": "file feile lima light terminal cylinder zylinder cylindre cilindro connector connecteur conector socket prise wire draht fil alambre hilo cable resin resine harz pump flange process processus proceso job plug screw "
    "grease nipple naphtha ignition plant coating watchdog parent child shaft valve piston operator deburr",
    # talk about a word
    "quote": "word words term terms mot terme wort begriff palabra término filter list lexicon dictionary moderation example",
    # somebody else's speech
    "report": "said says wrote writes reported reports reporting called quoted quotes quote message comment comments post posts example dit disait écrit écrivait signalé commentaire sagte schrieb gemeldet kommentar beispiel dijo escribió denunció comentario ejemplo exemple",
}
#: Kinds whose terms are also met misspelled, by at most (letters + 1) / 5 edits; the others as they are, or masked.
SPELLED = ("slur", "insult", "away", "group", "dehuman", "creature", "porn", "sexual", "bare")
#: Kinds of which a hit makes a sentence worth scoring.
LEADING = frozenset(["slur", "insult", "away", "threat", "group", "dehuman", "creature", "harm", "porn", "sexual", "bare"])
#: Endings of the names of peoples (English, French, Spanish, German).
_PEOPLE = re.compile(r"(?:ans|ish|ese|iens|ards|ais|ois|anos|enses|eses|ianer|volk|ier)$")
THRESHOLD = 0.5
#: States that an automaton keeps, at most; letters of terms that are met inside a joined token, at least.
STATES, JOINED = 200_000, 4
# Signs and digits written for a letter.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t"}
MASKS = "*#_-.•●×?%&~^"
_UNSEEN = re.compile("[­͏​-‏‪-‮⁠-⁯︀-️﻿]")


@cache
def folding() -> dict[int, str]:
    """Plain lower-case letters for variants, look-alikes and accented letters."""
    one, more = variants()
    table = dict(one) | dict(more)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code) and plain.isascii():
            table[chr(code)] = plain
    table |= {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "’": "'", "ʼ": "'", "‘": "'"}
    return {ord(k): v.lower() for k, v in table.items()} | {c: "" for c in range(0x300, 0x370)}


def folded(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if text.isascii():
        return text.lower()
    return _UNSEEN.sub("", text.lower()).translate(folding())


#: Kinds of terms that abuse runs together; a bastard file in one word is none.
RUN_TOGETHER = frozenset(["slur", "insult", "away", "push", "weak", "you", "dehuman", "porn", "sexual"])


class Automaton:
    """The product of a Levenshtein automaton and the trie, made deterministic as tokens are read.

    A state is a set of (trie node, edits left); ``step`` keeps the transitions it has met.
    """

    def __init__(self, terms: dict[str, set[str]], spelled: set[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.kinds: list[frozenset[str]] = [frozenset()]
        self.fuzzy: list[int] = [0]  # the most edits of any term below a node
        for term, kinds in terms.items():
            node, edits = 0, (len(term) + 1) // 5 if term in spelled and len(term) >= 6 else 0
            self.fuzzy[0] = max(self.fuzzy[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.kinds.append(frozenset())
                    self.fuzzy.append(0)
                node = self.children[node][c]
                self.fuzzy[node] = max(self.fuzzy[node], edits)
            self.kinds[node] = self.kinds[node] | kinds
        self.edits = {term: (len(term) + 1) // 5 if term in spelled and len(term) >= 6 else 0 for term in terms}
        self.end: dict[int, int] = {}
        for term in terms:
            node = 0
            for c in term:
                node = self.children[node][c]
            self.end[node] = self.edits[term]
        start = self.closed({(0, 0)})
        self.states: dict[frozenset, int] = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]

    def closed(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of the term that the token lacks; of one node the fewest edits stay."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            if best.get(node, 99) <= used or used > self.fuzzy[node]:
                continue
            best[node] = used
            todo += [(n, used + 1) for n in self.children[node].values() if node]
        return frozenset(best.items())

    def step(self, state: int, c: str) -> int:
        """The state after ``c``, -1 if no term can follow."""
        to = self.moves[state].get(c)
        if to is not None:
            return to
        masked, letters = c in MASKS, LEET.get(c, c)
        after: set[tuple[int, int]] = set()
        for node, used in self.sets[state]:
            for x, n in self.children[node].items():
                if masked or x in letters:
                    after.add((n, used))
                elif node:
                    after.add((n, used + 1))
            if node:
                after.add((node, used + 1))
        new = self.closed(after)
        to = -1
        if new:
            to = self.states.setdefault(new, len(self.sets))
            if to == len(self.sets):
                self.sets.append(new)
                self.moves.append({})
        self.moves[state][c] = to
        return to

    def forget(self) -> None:
        """Drops all states but the first; they are made again as tokens are read."""
        start = self.sets[0]
        self.states, self.sets, self.moves = {start: 0}, [start], [{}]

    def kinds_of(self, token: str) -> frozenset[str]:
        """Kinds of the nearest terms to ``token``."""
        if len(self.sets) > STATES:
            self.forget()
        state = 0
        for c in token:
            state = self.step(state, c)
            if state < 0:
                return frozenset()
        found = [(used, self.kinds[node]) for node, used in self.sets[state] if node in self.end and used <= self.end[node]]
        least = min((used for used, _ in found), default=0)
        return frozenset().union(*(kinds for used, kinds in found if used == least))

    def joined(self, token: str) -> frozenset[str]:
        """Kinds of the terms of ``JOINED`` letters or more that ``token`` is written of without blanks between, two at least."""
        kinds: list[frozenset[str] | None] = [frozenset(), *[None] * len(token)]
        for i, before in enumerate(kinds):
            node = 0
            for j in range(i, len(token)) if before is not None else ():
                node = self.children[node].get(token[j], 0)
                if not node:
                    break
                if node in self.end and j + 1 - i >= JOINED and (i or j + 1 < len(token)) and self.kinds[node] <= RUN_TOGETHER:
                    kinds[j + 1] = (kinds[j + 1] or frozenset()) | before | self.kinds[node]
        found = kinds[-1] or frozenset()
        return found | {"slur"} if "insult" in found else found  # insults run together are one by themselves


@cache
def automaton() -> Automaton:
    terms: dict[str, set[str]] = {}
    for kind, words in LEXICON.items():
        for word in words.split():
            terms.setdefault(folded(word), set()).add(kind)
    # Both spellings of umlauts are met.
    return Automaton(terms, {t for t, kinds in terms.items() if kinds & set(SPELLED)})


_seen: dict[str, frozenset[str]] = {}
_leads: set[str] = set()
_TRIM = " \t\n,;:!?()[]{}\"'«»“”„.…/\\"
_REPEAT = re.compile(r"([a-z])\1{2,}")
_SPELT = re.compile(r"^[^\W_](?:[.\-_·/ ][^\W_])+$")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?=[.,;:!?]*(?:\s|$))")
#: Kinds that count only as they are written.
_EXACT = frozenset(["technical", "quote", "report", "self"])
#: Words of one letter that have a kind.
_SINGLE = frozenset("i")


def _unspaced(m: re.Match[str]) -> str:
    """A word whose letters stand apart; letters at its ends that are words by themselves are left alone."""
    letters = m.group().split()
    n = len(letters)
    for size in range(n, 2, -1):
        for begin in range(n - size + 1):
            word = "".join(letters[begin : begin + size])
            if token_kinds(word) if size == n else not LEADING.isdisjoint(token_kinds(word)):
                return " ".join([*letters[:begin], word, *letters[begin + size :]])
    return m.group()


def plain_letters(word: str) -> bool:
    return all(c.isalpha() or c in "'-" for c in word)


def token_kinds(token: str) -> frozenset[str]:
    """The kinds of a lower-case token as it stands between blanks."""
    kinds = _seen.get(token)
    if kinds is None:
        if len(_seen) > 1_000_000:  # only a memory of what was computed
            _seen.clear()
            _leads.clear()
        word = folded(token).strip(_TRIM)
        kinds = frozenset()
        if any(c.isalpha() for c in word) and (len(word) > 1 or word in _SINGLE):
            plain = _REPEAT.sub(r"\1", word)
            if _SPELT.match(word):
                plain = re.sub(r"[.\-_·/ ]", "", word)
            # A mask needs some letters beside it, more for short words.
            letters = sum(c.isalnum() or c in "@$!|" for c in plain)
            if plain.isalpha() or "'" in plain or letters * 3 >= len(plain) or (plain[0].isalpha() and len(plain) >= 5):
                kinds = automaton().kinds_of(plain)
                if not kinds and plain != word:
                    kinds = automaton().kinds_of(re.sub(r"([a-z])\1+", r"\1", word))
                if not kinds and plain != word:
                    kinds = automaton().kinds_of(re.sub(r"([a-z])\1+$", r"\1", word))
                if not kinds and "'" in plain:
                    kinds = automaton().kinds_of(plain.rpartition("'")[2])
                if not kinds and "-" in plain and word.replace("-", "").isalpha():
                    for part in word.split("-"):
                        kinds = kinds | automaton().kinds_of(part)
                if not kinds and len(plain) >= 2 * JOINED:
                    kinds = automaton().joined(plain)
            if kinds and plain != folded(token).strip(_TRIM) or not plain_letters(word):
                kinds = kinds - _EXACT
        _seen[token] = kinds
        if not LEADING.isdisjoint(kinds):
            _leads.add(token)
    return kinds


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


_OPENS, _CLOSES = "\"«“„‘", "\"»”“’"
_WRAPPED = re.compile(r"(?<=[^\s.!?…:;])[ \t]*\r?\n[ \t]*(?=[a-zà-ÿ])")


def quoted(tokens: list[str]) -> list[bool]:
    """Whether each token stands inside quotation marks."""
    out, inside = [], False
    for token in tokens:
        core = token.strip(".,;:!?…()")
        inside = inside or core[:1] in _OPENS and bool(core)
        out.append(inside)
        if inside and core[-1:] in _CLOSES and len(core) > 1:
            inside = False
    return out


def framed(kinds: list[frozenset[str]], tokens: list[str]) -> tuple[int, int, bool]:
    """Demeaning words and creatures that a noun is called (noun, copula, at most four words, the term; or the term, then
    ``that they are``), and whether that noun names people by its kind or ending."""
    copulas = [i for i, k in enumerate(kinds) if "copula" in k]
    demanded = any("expel" in k for k in kinds)
    called = lambda i: any(0 < i - c <= 5 for c in copulas) or any(0 < c - i <= 4 and c - 1 in copulas for c in copulas) or i > 0 and "these" in kinds[i - 1] and demanded
    strong = sum("dehuman" in k and called(i) for i, k in enumerate(kinds))
    weak = sum("creature" in k and called(i) for i, k in enumerate(kinds))
    nouns = [t.strip(_TRIM) for c in copulas for t in tokens[max(0, c - 3) : c]]
    return strong, weak, any(len(t) >= 6 and _PEOPLE.search(t) for t in nouns)


def sentence_score(tokens: list[str], near: list[str]) -> float:
    """How abusive a stretch of a sentence is, from the kinds that meet in it; ``near`` are the words right beside the hits.

    Insults count when aimed at a person or standing alone; threats when somebody announces harm to the person spoken to;
    groups, of any name, when called something in a frame of noun, copula and term, or when violence is called for; sexual
    words when people, bareness or undressing meet.  Technical company and talk about words, right beside them, lower the
    score, and so does reported speech: hits that stand in quotation marks beside a word of saying outside them.
    """
    kinds = [token_kinds(t) for t in tokens]
    has: dict[str, int] = {}
    for k in kinds:
        for kind in k:
            has[kind] = has.get(kind, 0) + 1
    n = lambda kind: has.get(kind, 0)
    beside = lambda kind: sum(kind in token_kinds(t) for t in near)
    aimed = n("you") + n("crowd") + n("writer")
    away = n("away") + n("push")
    insult = 0.0
    if n("slur"):
        insult = 0.35 + 0.25 * min(2, away + aimed + n("insult") + n("slur") - 1)
        if len(tokens) <= 2:
            insult = max(insult, 0.6)
    if n("insult") and len(tokens) <= 2 and any("!" in t for t in tokens):
        insult = 0.6
    if n("insult"):
        insult = max(insult, 0.1 + 0.2 * min(4, (n("insult") - 1) + away + aimed + n("weak")) if away + aimed else 0.1)
    if n("away") and away >= 2 and n("you"):
        insult = max(insult, 0.5 + 0.1 * n("insult"))
    if n("threat") and n("you") and n("self"):
        insult = max(insult, 0.6)
    hate = 0.0
    if n("dehuman") + n("creature") + n("harm") + n("slur") + n("remove") > 0:
        strong, weak, people = framed(kinds, tokens)
        group = bool(n("group"))
        harm, remove = n("harm"), n("remove")
        if strong:
            hate = 0.35 + 0.25 * min(1, harm + remove) + 0.15 * min(1, strong + weak - 1) + 0.2 * (group or people)
        elif weak:
            hate = 0.1 + 0.45 * (remove > 0 and (harm > 0 or group or people)) + 0.25 * min(2, weak) * group
        if n("expel") and strong + weak:
            hate = max(hate, 0.6)
        if group and harm + n("slur") and remove:
            hate = max(hate, 0.2 + 0.2 * min(3, harm + remove) + 0.1 * n("slur"))
        words = {t.strip(_TRIM) for t in tokens}
        if {"moins", "gagne"} <= words or {"only", "good", "dead"} <= words or {"toter", "guter"} <= words or {"mort", "bon", "seul"} <= words or {"muerto", "bueno", "único"} <= words:
            hate = max(hate, 0.6)
    sexual = 0.0
    if n("sexual") + n("porn") or n("bare") >= 2:
        met = min(2, n("sexual")) + 2 * min(1, n("porn")) + min(2, n("bare")) + min(2, n("bodies") + n("slur")) + min(2, n("undress"))
        sexual = 0.18 * met if n("bodies") + n("slur") + n("porn") or n("bare") + n("undress") >= 2 else 0.0
    worst = max(insult, hate, sexual)
    inside = quoted(tokens)
    reported = any(inside) and any("report" in k and not q for k, q in zip(kinds, inside)) and all(q for k, q in zip(kinds, inside) if not LEADING.isdisjoint(k))
    return max(0.0, min(1.0, worst - 0.3 * min(2, beside("technical")) * (hate < 0.5) - 0.2 * min(2, beside("quote")) - 0.6 * reported))


def document_score(text: str | None) -> tuple[float, str]:
    """The score of the worst sentence, and that sentence."""
    if not text:
        return 0.0, ""
    lower = text.lower()
    tokens = set(lower.split())
    for token in tokens.difference(_seen):
        token_kinds(token)
    if sum(len(t.strip(_TRIM)) == 1 for t in tokens) >= 2 and _SPACED.search(lower):
        text = _SPACED.sub(_unspaced, lower)
        lower = text.lower()
        tokens = set(lower.split())
        for token in tokens.difference(_seen):
            token_kinds(token)
    leads = tokens.intersection(_leads)
    if not leads:
        return 0.0, ""
    best, where = 0.0, ""
    # Lines that go on in small letters are one sentence.
    for sentence in _SENTENCE.split(_WRAPPED.sub(" ", text).lower()):
        tokens = sentence.split()
        if leads.isdisjoint(tokens):
            continue
        tokens = folded(" ".join(tokens)).split()
        kinds = [token_kinds(t) for t in tokens]
        at = [i for i, k in enumerate(kinds) if k and not LEADING.isdisjoint(k)]
        # Context windows around the hits: a long sentence without stops isn't one context.
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= 6:
                j += 1
            window = tokens[max(0, at[i] - 9) : at[j] + 10]
            score = sentence_score(window, tokens[max(0, at[i] - 4) : at[j] + 5])
            if score > best:
                best, where = score, " ".join(window)
            i = j + 1
    return round(best, 4), where


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [document_score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for s, _ in found], pa.float64())], [*batch.schema.names[:-1], "score"])


def abuse_scores(documents: DataFrame) -> DataFrame:
    """doc_id, source, score, abusive for every document."""
    slim = documents.select("doc_id", "source", "text")
    scored = slim.mapInArrow(_scored, "doc_id bigint, source string, score double")
    return scored.withColumn("abusive", F.col("score") >= THRESHOLD)


def source_rates(documents: DataFrame) -> DataFrame:
    """source, n_documents, n_abusive, rate; a null source is a source of its own."""
    by = abuse_scores(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"))
    return by.withColumn("rate", F.round(F.col("n_abusive") / F.col("n_documents"), 6))
