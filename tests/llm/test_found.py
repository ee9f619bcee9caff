"""The problems' queries against plain versions that share no code with them, on the smallest tables and by hand."""

import collections
import os
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnwise.llm import abuse, byte_pairs, event_runs, leaks, nearest_time, personal_data, plain_text, queries, speaker_turns
from turnwise.sources.tables import table

ASR = "rec_id bigint, seg_idx bigint, start_s double, end_s double, text string, speaker string, arrived_at string, clash string"


def asr(spark, rows):
    """Segments (rec_id, seg_idx, start, end, text, speaker), with a further column of a clashing name."""
    df = spark.createDataFrame([(*r, None, "x") for r in rows], ASR)
    return df.withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz")).withColumnRenamed("clash", "first")


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert collections.Counter(tuple(x[c] for c in order) for x in df.collect()) == collections.Counter(tuple(x[names.index(c)] for c in order) for x in r.fetchall())


def test_runs_by_hand(spark):
    rows = [
        (1, 3, 0.0, 1.0, "a", "SPEAKER_01"), (1, 2, 1.0, 2.0, None, "s1"), (1, 9, 2.0, 1.5, "", "?"), (1, 9, 2.0, 1.5, "", "?"), (1, 1, 3.0, 4.0, "b", "locuteur 1"),
        (1, 4, 5.0, 6.0, "c", "2"), (1, 5, None, 6.0, "c", "2"), (1, 6, 7.0, 7.0, "c", "spk_1"), (1, 7, 700.0, 701.0, "c", "spk1"), (2, 1, 0.0, 1.0, "c", None), (None, 1, 0.0, 1.0, "c", "1"),
    ]
    got = {(r.first_seg_idx, r.last_seg_idx, r.n_events, r.duration_ms) for r in event_runs.speaker_runs(asr(spark, rows)).collect()}
    assert got == {(3, 1, 3, 4000), (6, 7, 2, 694000)}
    assert event_runs.speaker_runs(asr(spark, [])).count() == 0


def reading(text):
    """A text as it reads, by the character database and a list of look-alikes."""
    likes = {c: p for p, like in plain_text.LOOK_ALIKES.items() for c in like}
    out = []
    for c in text:
        if unicodedata.category(c) == "Cf":
            continue
        name = unicodedata.decomposition(c).partition(" ")[0]
        c = likes.get(c, c)
        out.append(unicodedata.normalize("NFKC", c) if name in ("<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>") else c)
    return unicodedata.normalize("NFC", " ".join("".join(out).split()))


def test_same_reading(spark, small, con):
    rows = {(r, s): t for r, s, t in con.execute("SELECT rec_id, seg_idx, text FROM asr_segments WHERE text IS NOT NULL").fetchall()}
    groups = collections.defaultdict(list)
    for (r, s), t in rows.items():
        if reading(t):
            groups[r, reading(t)].append((s, t))
    expected = {(r, min(a, b), max(a, b)) for (r, _), g in groups.items() for i, (a, x) in enumerate(g) for b, y in g[:i] if x != y}
    got = [tuple(x) for x in entry.queries()["p3_found"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


@pytest.mark.parametrize("text,plain", [("Ｌｅ ｐｌａｎ​ｎｉｎｇ", "Le planning"), ("rе́gie", "régie"), ("ﬁche­", "fiche"), (" 　‍", ""), (None, None), ("TK‐\U0001d5ee", "TK-a"), ("Oui", "Oui"), ("l’été…", "l’été…")])
def test_plain_text(spark, text, plain):
    df = spark.createDataFrame([(text, 1)], "text string, plain int")
    assert plain_text.with_plain_text(df, "text").first().plain_text == plain


def test_long_text(spark):
    df = spark.createDataFrame([("ａ" * 200_000 + " b",)], "text string")
    assert plain_text.with_plain_text(df, "text").select(F.length("plain_text")).first()[0] == 200_002


def test_nearest():
    lt, rt, ri = np.array([100, 500, 900]), np.array([60, 140, 140, 500, 1201]), np.array([1, 2, 3, 4, 5])
    assert nearest_time.nearest(lt, rt, ri, 300).tolist() == [0, 3, -1]
    assert nearest_time.nearest(lt, np.empty(0, np.int64), np.empty(0, np.int64), 300).tolist() == [-1, -1, -1]


def test_joiner_emits_evicts_and_times_out():
    import pandas as pd

    class State:
        value, timed, at = None, False, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        hasTimedOut = property(lambda self: self.timed)

        def update(self, v):
            self.value = v

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, t):
            self.at = t

        def getCurrentWatermarkMs(self):
            return 0

    rows = lambda *r: pd.DataFrame(r, columns=["k0", "is_left", "id", "at_ms"])
    state, join = State(), nearest_time.joiner(1, 300, 0)
    out = list(join((0, 0), iter([rows((7, True, 1, 1000), (7, False, 1, 1200), (7, True, 2, 5000))]), state))
    assert out[0][["left_id", "right_id", "distance_ms"]].values.tolist() == [[1, 1, 200]]
    assert state.value[0] == [7, 5000, 2] and state.value[1] == []  # the left row waits, the right row is evicted
    assert list(join((0, 0), iter([rows((7, False, 2, 4900), (7, False, 3, 100))]), state)) == []
    state.timed = True
    out = list(join((0, 0), iter([]), state))
    assert out[0][["left_id", "right_id", "distance_ms"]].values.tolist() == [[2, 2, 100]] and state.value is None


SOUNDS = "applaudissements|bruit de fond|inaudible|musique|porte qui claque|rires|silence|sonnerie de téléphone|soupir|toux|applause|background noise|coughs|crosstalk|door slams|laughter|music|phone ringing|sighs"


def plain_turns(rows):
    """Turns by a loop over one recording's pieces after another."""
    label = re.compile(r"(?i)\[spk(\d+)\]|<speaker (\d+)>|(?<!\w)(?:speaker[ _]|spk_?|locuteur )(\d+)(?: ?:| -(?= ))")
    out = collections.defaultdict(list)
    for r, s, a, b, text, speaker in sorted(rows, key=lambda x: (x[0], x[2], x[3], x[1])):
        digits = re.search(r"\d+", speaker or "")
        who, at, pieces = int(digits[0]) if digits else None, 0, []
        for m in label.finditer(text or ""):
            pieces.append((who, text[at : m.start()]))
            who, at = int(next(x for x in m.groups() if x)), m.end()
        for who, said in [*pieces, (who, (text or "")[at:])]:
            said = re.sub(rf"(?i)[\[({{<*♪] ?(?:{SOUNDS})(?:\.\.\.)? ?[\])}}>*♪]", " ", said)
            said = re.sub(r"[\[<({][^\])>}]*\d[\d:.]*s?[\])>}]|\d+:\d+:\d+,\d+ --> \S+|\d+:\d+:\d+ -", " ", said)
            said = re.sub(r"(?i)(?<!\w)(e+u+h+|h+e+u+|h+u+m+|h+m+|u+h+|u+m+|erm)(?!\w)", " ", said)
            if who is not None and re.search(r"\w", said):
                last = out[r][-1] if out[r] else None
                if last and last[0] == who:
                    last[2] = s
                else:
                    out[r].append([who, s, s])
    return {(r, *t) for r, ts in out.items() for t in ts}


def test_turns(spark, small, con):
    rows = con.execute(
        "SELECT DISTINCT rec_id, seg_idx, round_even(least(start_s, end_s) * 1000, 0), round_even(greatest(start_s, end_s) * 1000, 0), text, speaker FROM asr_segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL"
    ).fetchall()
    got = [tuple(x) for x in entry.queries()["p5_found"](spark, small).select("rec_id", "speaker", "first_seg_idx", "last_seg_idx").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_turns(rows)


def test_turns_by_hand(spark):
    rows = [
        (1, 1, 0.0, 1.0, "[00:01] euh", "S0"), (1, 2, 1.0, 2.0, "oui [SPK2] non [rires] (je note)", "S0"), (1, 3, 2.0, 3.0, "encore", "SPEAKER_02"), (1, 4, 3.0, 4.0, "qui ?", "n/a"), (1, 5, 4.0, 5.0, "moi", "2"),
        (1, 6, 5.0, 6.0, "le speaker 2 du panel", "locuteur 0"), (1, 7, 6.0, 7.0, None, "2"), (1, 8, 7.0, 8.0, "a [SPK1] b [SPK0] c", "S0"), (2, 1, 0.0, 1.0, "x", None),
    ]
    got = sorted((r.speaker, r.first_seg_idx, r.last_seg_idx) for r in speaker_turns.speaker_turns(asr(spark, rows)).collect())
    assert got == [(0, 2, 2), (0, 6, 8), (0, 8, 8), (1, 8, 8), (2, 2, 5)]
    assert speaker_turns.speaker_turns(asr(spark, [])).count() == 0


def test_label_clusters():
    got = speaker_turns.clusters(["SPEAKER_01", "s1", "locuteur 1", "2", "n/a", "unknown", "Marie Dupont", "marie dupond", "Marc Ferrand", "inconnu 3"])
    numbered = {"SPEAKER_01": 1, "s1": 1, "locuteur 1": 1, "2": 2}
    assert {x: n for x, (n, _) in got.items() if n is not None} == numbered
    assert got["n/a"] == got["unknown"] == got["inconnu 3"] == (None, None)
    assert got["Marie Dupont"] == got["marie dupond"] != got["Marc Ferrand"] and all(got[x][1] for x in ("Marie Dupont", "Marc Ferrand"))


def test_canonical_turns(spark):
    """Named labels cluster by initial and similarity and have turns of their own; numbered turns are not cut by them."""
    rows = [(1, 1, 0.0, 1.0, "oui", "Marie Dupont"), (1, 2, 1.0, 2.0, "non", "marie dupond"), (1, 3, 2.0, 3.0, "si", "S1"), (1, 4, 3.0, 4.0, "ah", "Marc"), (1, 5, 4.0, 5.0, "bon", "spk 1"), (1, 6, 5.0, 6.0, "rien", "?")]
    got = sorted((r.first_seg_idx, r.last_seg_idx, r.canonical) for r in speaker_turns.canonical_turns(asr(spark, rows)).collect())
    assert [g[:2] for g in got] == [(1, 2), (3, 3), (4, 4), (5, 5)] and [g[2] for g in got][1::2] == ["1", "1"]
    assert [(r.first_seg_idx, r.last_seg_idx, r.speaker) for r in speaker_turns.speaker_turns(asr(spark, rows)).collect()] == [(3, 5, 1)]


def test_turns_have_their_clean_text(spark):
    """The cleaned words of each piece come out with its turn, in order; across blocks too, and from the row that p5_found takes."""
    rows = [
        (1, 1, 0.0, 1.0, "[00:01] euh, bonjour   à tous", "S0"), (1, 2, 1.0, 2.0, "...oui [SPK2]: non [rires] (je note) <t=3.0>", "S0"), (1, 3, 2.0, 3.0, "- encore euh  (rires) une fois", "SPEAKER_02"),
        (1, 4, 3.0, 4.0, "hum [bruit]", "S0"), (1, 5, 700.0, 701.0, "après\tla pause", "2"), (1, 6, 702.0, 703.0, "merci", "Marie"), (1, 6, 702.0, 703.0, "merci", "Marie"), (1, 7, 703.0, 704.0, None, "Marie"),
    ]
    got = sorted((r.first_seg_idx, r.last_seg_idx, r.canonical, r.n_pieces, r.text) for r in speaker_turns.canonical_turns(asr(spark, rows)).collect())
    assert got == [(1, 2, "0", 2, "bonjour à tous oui"), (2, 5, "2", 3, "non (je note) encore une fois après la pause"), (6, 6, "marie", 1, "merci")]


def test_turns_of_numbers_are_those_with_texts(spark, small):
    found = {tuple(r) for r in entry.queries()["p5_found"](spark, small).collect()}
    turns = entry.queries()["p5_turns"](spark, small).where(F.col("canonical").rlike("^[0-9]+$"))
    assert turns.where(~F.col("text").rlike(r"[\p{L}\p{N}]")).count() == 0
    assert {(r.rec_id, int(r.canonical), r.first_seg_idx, r.last_seg_idx) for r in turns.collect()} == found


CATALOG = [("Zoé Marvalgier", "PERSON"), ("Victor", "PER"), (" rose marvalgier ", None), ("Pyxilis", "ORG"), (None, "PERSON"), ("Ostrerinel", "LOC")]
CASES = {
    "Envoyez le dossier à zoe.marvalgier@pyxilis.test svp": {"EMAIL"}, "zoe point x arobase pyxilis point test pour la copie": {"EMAIL"}, "write to me at zoe at pyxilis dot test": {"EMAIL"}, "La touche @ du clavier est coincée": set(),
    "rappelez-moi au 06 39 98 12 86": {"PHONE"}, "call me back on (440) 555-0143": {"PHONE"}, "tel zéro trois cinq trois zéro un quatre quatre huit zéro": {"PHONE"}, "La commande 346412989 coûte 530 euros": set(),
    "la version 3.14.15.92 plante toujours": set(), "le numéro, c'est SIREN 772 422 739": {"ID_NUMBER"}, "notez bien FR27 2463 8709 4881 1067 9148 126": {"ID_NUMBER"}, "passport number 86FV80971": {"ID_NUMBER"}, "on en est à 6-3, 6-4, 7-5": set(),
    "j'habite 20 bis chemin du Vieux Moulin à Ostrerinel": {"ADDRESS"}, "I live at twelve Bramble Drive, Ostrerinel": {"ADDRESS"}, "The street is closed, the avenue is open": set(), "Je m'appelle Zoé Marvalgier": {"PERSON"},
    "it was signed by Dr. Ulbawickam": {"PERSON"}, "Il y avait une rose posée sur le bureau": set(), "Chez Pyxilis, le planning prépare les essais": set(), "Madame la directrice n'est pas encore là": set(),
}


def test_personal_data(spark):
    rows = [(1, i, 0.0, 1.0, t, "1") for i, t in enumerate([*CASES] * 30)] + [(1, 10_000, 0.0, 1.0, None, "1"), (1, 10_001, 0.0, 1.0, " ", "1")]
    catalog = spark.createDataFrame(CATALOG, "pattern string, entity_type string")
    got = collections.defaultdict(set)
    for r in personal_data.found_types(asr(spark, rows + rows[:5]), catalog).collect():
        assert r.pii_type not in got[r.seg_idx]
        got[r.seg_idx].add(r.pii_type)
    wrong = {t: (got[i], want) for i, (t, want) in enumerate(CASES.items()) if got[i] != want}
    assert not wrong
    rows_masked = personal_data.masked_segments(asr(spark, rows + rows[:5]), catalog).collect()
    masked = {r.seg_idx: r.masked for r in rows_masked}
    assert len(rows_masked) == len(rows)
    assert masked[0] == "Envoyez le dossier à <EMAIL> svp" and masked[10_000] is None and masked[10_001] == " "
    assert personal_data.found_types(asr(spark, []), catalog).count() == 0
    assert personal_data.found_types(asr(spark, rows), catalog.limit(0)).where("pii_type = 'EMAIL'").count() == 90


# Written by hand: names outside the tables' frames and forms that no table holds.
UNFRAMED = {
    "Thibault Garnier présente le budget": "PERSON", "My colleague Rachel Whitcombe is going to Leeds": "PERSON", "Dossier suivi par Bertrand Lacombe": "PERSON", "Hier Sylvain Bourdet a proposé un plan": "PERSON",
    "then Oliver Prentwood said no": "PERSON", "tel:0612345678": "PHONE", "0 6 1 2 3 4 5 6 7 8 pour rappeler": "PHONE", "écris à x[at]y.fr": "EMAIL", "12 Park Hill please": "ADDRESS", "GB29NWBK60161331926819": "ID_NUMBER",
    "la réunion de lundi est annulée": None, "We ship 400 items to Leeds": None, "Bonjour à tous": None, "The budget is 12 000 euros": None,
}


def test_personal_data_outside_frames(spark):
    """The classifier decides candidates that no labeler of the catalog speaks for."""
    rows = [(1, i, 0.0, 1.0, t, "1") for i, t in enumerate([*CASES] * 20 + [*UNFRAMED])]
    catalog = spark.createDataFrame(CATALOG, "pattern string, entity_type string")
    got = collections.defaultdict(set)
    for r in personal_data.found_types(asr(spark, rows), catalog).collect():
        got[r.seg_idx].add(r.pii_type)
    wrong = {t: (got[len(CASES) * 20 + i], want) for i, (t, want) in enumerate(UNFRAMED.items()) if got[len(CASES) * 20 + i] != ({want} if want else set())}
    assert len(wrong) <= 1, wrong


def test_longest_finding_is_masked():
    assert personal_data.masked_text("a bc d", [(2, 3, "PERSON"), (2, 6, "ADDRESS"), (0, 3, "EMAIL")]) == "a <ADDRESS>"


def test_personal_data_found(spark, small):
    rows = entry.queries()["p6_found"](spark, small).collect()
    assert len(rows) == len(set(map(tuple, rows))) and {r.pii_type for r in rows} <= set(personal_data.TYPES[:-1])


def tiktoken_ids(texts):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t or "") for t in texts]


def test_ids(spark):
    texts = [
        None, "", " ", "Hello world", "l'été déjà vu's they'll", "a b 　 c\n\n  d", "x" * 3000, "zq" * 700 + "​", "日本語 😀👍🏽", "12345678901234567890 1,7-dioxane", "<|endoftext|> <|startoftext|>", "\x1c\x85  ", "é ﬁ ½ ²",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, "Hello world"])], "doc_id bigint, text string, ids string")
    tokens = byte_pairs.token_ids(df)
    got = {r.doc_id: list(r.ids) for r in tokens.collect()}
    assert [got[i] for i in range(len(texts))] == tiktoken_ids(texts) and len(got) == len(texts) + 1
    back = {r.doc_id: r.text for r in byte_pairs.decoded(tokens).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert byte_pairs.token_ids(df.limit(0)).count() == 0


def test_ids_of_documents(spark, small, con):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: list(r.ids) for r in entry.queries()["p7_ids"](spark, small).collect()}
    assert got == dict(zip([d for d, _ in rows], tiktoken_ids([t for _, t in rows])))


ITEM = "After 146 minutes the ladder near the bright courier weighs one damp mandrel and nobody follows the saddle unless its pendulum is removable"


def leaked(spark, texts, items=((1, ITEM, "C"), (2, None, None), (3, "True or false?", "B"), (4, "", None))):
    filler = "The device comprises a piston, a housing and a spring whose thickness is measured by the sensor of the valve."
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, filler + f" Part {i}.", "x") for i in range(300)], "doc_id bigint, text string, item_id string")
    found = leaks.leaked_items(docs, spark.createDataFrame(list(items), "item_id bigint, text string, answer string"))
    return sorted((r.doc_id, r.item_id) for r in found.collect())


def test_leaks(spark):
    words = ITEM.split()
    texts = [
        "Intro text. " + ITEM + " The end.", " ".join(words[4:16]), " ".join(words[4:15]), " ".join(words[:5] + ["x"] + words[6:14]), " ".join(words[:5] + words[6:14]), " ".join(words[:6] + words[5:14]),
        " [12] ".join(words[:13]), "<b>" + "</b> <i>".join(words[:13]).upper(), "minu-\n".join(ITEM.split("minu")), " ".join("".join(c + "́" if c == "e" else c for c in w) for w in words[:13]), "".join({"a": "а", "o": "о"}.get(c, c) for c in ITEM),
        None, "", " ".join(words[::-1]), " ".join(w if i % 4 else "x" for i, w in enumerate(words)), ITEM, "word " * 40_000 + ITEM,
    ]
    hit = [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16]
    assert leaked(spark, texts) == [(i, 1) for i in hit]
    assert leaked(spark, texts, [(2, None, None)]) == [] and leaked(spark, []) == []


def test_leaks_of_common_words(spark):
    """An item whose words are in most documents carries no weight and is still found; long markup is none of the words."""
    common = "the part of the device is in the housing and the cover is on the side of the base".split()
    item = " ".join(common)
    texts = [f"Text {i}. " + " ".join(common[k:] + common[:k]) for i, k in enumerate([3, 5, 7, 9, 11, 13] * 60)] + ["So " + item + ".", '<a href="' + "x" * 300 + '">'.join(["", *ITEM.split()[:14]])]
    got = leaked(spark, texts, [(1, ITEM, "C"), (5, item, None)])
    assert (360, 5) in got and (361, 1) in got


def test_chain_is_not_hidden():
    """A stray triple between two long blocks changes nothing."""
    block = [(i, i) for i in range(298)] + [(i + 301, i + 301) for i in range(298)]
    assert leaks.longest_chain(np.array(block).T)[0] == 601
    assert leaks.longest_chain(np.array(block + [(5, 250)]).T)[0] == 601


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(1, 5, rng.integers(0, 12)).tolist() for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert leaks.common_subsequence(a, b) == row[-1]


def test_paraphrase_needs_the_answer(spark):
    words = ITEM.split()
    changed = [w if i % 4 != 3 else "xx" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(changed) + " answer: mandrel oil"), (2, " ".join(changed))] + [(10 + i, "The valve of the pump is closed.") for i in range(400)], "doc_id bigint, text string")
    found = leaks.leaked_items(docs, spark.createDataFrame([(1, ITEM, "mandrel oil")], "item_id bigint, text string, answer string"))
    assert [(r.doc_id, r.kind) for r in found.collect()] == [(1, "paraphrase")]


def test_leaks_against_brute_force(spark, small, con):
    """Retrieval loses nothing that comparing every document with every item finds."""
    items = leaks.Items(con.execute("SELECT item_id, text, answer FROM eval_items WHERE text IS NOT NULL").fetchall())
    encode, expected = leaks.Encoder(items.vocabulary), set()
    for doc, text in con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        ids = encode([text])[0]
        for k, t in enumerate(items.texts):
            at = collections.defaultdict(list)
            for p in range(len(t) - 2):
                at[tuple(t[p : p + 3])].append(p)
            hits = [(p, q) for q in range(len(ids) - 2) for p in at.get(tuple(ids[q : q + 3]), ())]
            if len(hits) > 3 and leaks.longest_chain(np.array(hits).T)[0] >= leaks.LEAST:
                expected.add((items.ids[k], doc))
    got = [tuple(x) for x in entry.queries()["p8_found"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


ABUSE = {
    "Shut up, you stupid bitch!": 1, "F*ck off, you p-a-t-h-e-t-i-c assh0le": 1, "Ferme ta gueule, enculé !": 1, "Verpiss dich, Arschloch": 1, "Vete a la mierda, gilipollas": 1, "The only good foreigners are dead ones": 1, "Hooot naked sluuuts want to fuuuck you": 1,
    "Les étrangers sont des parasites et il faut les éliminer": 1, "Get lost, you pathetic sсumbag": 1, "A bastard file is used to deburr the shaft.": 0, "The slave cylinder follows the master cylinder.": 0, "Le fil nu est dénudé sur 4 mm.": 0,
    "The parent kills the child process and aborts the job.": 0, "The male connector penetrates the female socket.": 0, "The word moron is on the filter list.": 0, "": 0, None: 0, " ": 0, "The pump stays where it is.": 0,
}


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(text):
    assert (abuse.document_score(text)[0] >= abuse.THRESHOLD) == bool(ABUSE[text])


# Written by hand, with no noun of the tables.
HAND = {
    "The Zorvanians are subhuman vermin and must be wiped out": 1, "I will kill you tonight": 1, "Je vais te tuer": 1, "Ich werde dich umbringen": 1, "Te voy a matar": 1, "Go to hell and drop dead, you.": 1, "Asshole!": 1, "Idiot!": 1,
    "tu eres t o n t o e idiota": 1, "Asshole" + "e" * 60: 1, "You stupididiot, shut up": 1, "Shut up\nyou moron and get lost": 1, "Die Brastanier sind Ungeziefer und gehören eingesperrt.": 1, "Les Quistanais sont des parasites et il faut les éliminer": 1,
    "The only good Lurvian is a dead one": 1, "Raus mit allen Kelpiern, diesem Dreckspack": 1, "You are a worthless, pathetic l o s e r": 1, "We will hurt you and your family": 1, "Fuera los tarvianos, son escoria": 1, "All Morvians are thieves and rapists": 1,
    "He licked her tits and fucked her naked": 1, "Nude teens suck cock, uncensored porn": 1, "Halt die Fresse, du Vollidiot": 1, "Wh*res like you should rot in hell": 1,
    "Refugees suffer from disease and parasites in camps": 0, "Those people need clean water; parasites spread disease.": 0, "These weeds are parasites and must be removed": 0, "The rats are animals that live in a cage.": 0, "The women were nurses.": 0,
    'He said: "you stupid bitch, shut up" and was reported.': 0, 'The report quotes a post as an example: "foreigners are vermin and should be shot".': 0, "The parent will kill the child process before you start": 0, "Die Bastardfeile dient zum Entgraten.": 0,
    "If you shut the valve, the pressure will drop.": 0, "The engine died and the driver got lost.": 0, "Dogs, cats and rats were examined for the disease": 0, "Die Tiere sind krank und sollen geheilt werden": 0, "Refugees and immigrants out of work receive a grant": 0, "The cage is lowered into the sea": 0,
}


def test_abuse_by_hand():
    """Recall and precision of at least nine tenths on sentences that share no noun with the tables."""
    found = {t for t in HAND if abuse.document_score(t)[0] >= abuse.THRESHOLD}
    true = {t for t, label in HAND.items() if label}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found), (true - found, found - true)


def test_automaton_forgets():
    made = abuse.Automaton({"asshole": {"a"}}, {"asshole"})
    for c in "abcdefgh":
        made.kinds_of("ass" + c * 3)
    n = len(made.sets)
    made.forget()
    assert len(made.sets) == 1 < n and made.kinds_of("assho1e") == {"a"}


def test_abuse_queries(spark, small):
    docs = table(spark, small, "documents")
    scores = abuse.abuse_scores(docs)
    assert scores.count() == docs.count()
    rates = {r.source: (r.n_documents, r.n_abusive) for r in abuse.source_rates(docs).collect()}
    assert sum(n for n, _ in rates.values()) == docs.count() and sum(a for _, a in rates.values()) == scores.where("abusive").count()


def test_automaton_against_distances():
    """The product of automaton and trie meets what comparing with every term meets."""
    terms = {"asshole": {"a"}, "gilipollas": {"b"}, "rot": {"c"}}
    made = abuse.Automaton(terms, set(terms))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y and y not in abuse.LEET.get(x, ""))))
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(600):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.integers(0, 3)):
            k = int(rng.integers(1, max(2, len(word))))
            word[k : k + int(rng.integers(0, 2))] = rng.choice(["x", "s", "", "o"])
        word = "".join(word)
        expected = {next(iter(k)) for t, k in terms.items() if word[:1] == t[:1] and distance(word, t) <= made.edits[t]}
        assert made.kinds_of(word) == frozenset(expected) or not expected


def test_nearest_by_hand(spark, tmp_path):
    """Ties, zero length, repeated rows, missing values, a tolerance's edge, a cut of the time axis, both directions."""
    cut = nearest_time.STRETCH_MS / 1000
    left = [
        (1, 1, 10.0, 11.0, "x", "S1"), (1, 2, 20.0, 21.0, None, "SPEAKER_01"), (1, 3, 30.0, 30.0, "", "1"), (1, 4, None, 5.0, "x", "1"), (1, 5, 40.0, 41.0, "x", "?"), (1, 6, cut, cut + 1, "x", "spk1"),
        (1, 7, 60.0, 50.0, "x", "1"), (1, 1, 10.0, 11.0, "x", "S1"), (2, 1, 10.0, 11.0, "x", "1"), (None, 1, 10.0, 11.0, "x", "1"), (9, 1, 5.0, 6.0, "x", "3"),
    ]
    right = [
        (1, 9, 9.7, 9.9, 1), (1, 4, 10.3, 12.0, 1), (1, 8, 19.9, 20.5, 1), (1, 7, 19.9, 20.4, 1), (1, 3, 20.1, 20.4, 1), (1, 2, 30.301, 31.0, 1), (1, 5, cut - 0.25, cut, 1), (1, 6, 50.1, 50.1, 1), (1, 6, 50.1, 50.1, 1),
        (2, 1, 10.0, 11.0, 2), (2, 2, 10.1, None, 1), (1, 1, 10.0, 11.0, None), (9, 1, 5.25, 6.0, 3),
    ]
    asr(spark, left).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(right, "rec_id bigint, seg_idx bigint, start_s double, end_s double, speaker int").write.parquet(str(tmp_path / "d"))
    stream = lambda n: nearest_time.table_stream(spark.read.parquet(str(tmp_path / n)), str(tmp_path / n))
    got = [tuple(r) for r in nearest_time.nearest_diarization(stream("a"), stream("d"), str(tmp_path / "end")).select("rec_id", "asr_seg_idx", "diar_seg_idx", "distance_ms").collect()]
    assert sorted(got) == [(1, 1, 9, 300), (1, 2, 7, 100), (1, 6, 5, 250), (1, 7, 6, 100), (9, 1, 1, 250)]


def test_nearest_over_several_batches(spark, tmp_path):
    """Files that come one a batch and out of order give the rows of one batch, if the lateness covers their disorder."""
    left = [(1, i, float(i), i + 1.0, "x", "S1") for i in range(40)]
    right = [(1, i, i + 0.1 * (i % 4), i + 1.0, 1) for i in range(40)]
    kind = "rec_id bigint, seg_idx bigint, start_s double, end_s double, speaker int"
    for k in (3, 0, 2, 1):  # later times first
        asr(spark, left[10 * k : 10 * k + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        spark.createDataFrame(right[10 * (3 - k) : 10 * (3 - k) + 10], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))

    def run(n, files, lateness):
        stream = lambda t: nearest_time.table_stream(spark.read.parquet(str(tmp_path / t)), str(tmp_path / t), files)
        rows = nearest_time.nearest_diarization(stream("a"), stream("d"), str(tmp_path / f"end{n}"), lateness_ms=lateness).collect()
        assert len(rows) == len(set(rows))
        return {(r.asr_seg_idx, r.diar_seg_idx, r.distance_ms) for r in rows}

    whole = run(0, None, 0)
    assert len(whole) == 40 and run(1, 1, 60_000) == whole
    assert run(2, 1, 0) < whole  # without lateness rows behind the watermark are dropped


def test_pairs_by_hand(spark):
    rows = [(1, 5, 0.0, 1.0, "Oui, oui", "1"), (1, 2, 0.0, 1.0, "Oｕi, oui", "1"), (1, 9, 0.0, 1.0, "Oui,  oui​", "1"), (1, 7, None, None, "Oui, oui", None), (1, 3, 0.0, 1.0, "oui, oui", "1"), (1, 4, 0.0, 1.0, None, "1"), (1, 6, 0.0, 1.0, "​", "1"), (1, 8, 0.0, 1.0, " ", "1"), (2, 1, 0.0, 1.0, "Oui , oui", "1")]
    got = sorted((r.seg_idx_a, r.seg_idx_b) for r in plain_text.same_reading(asr(spark, rows + rows[:2])).collect())
    assert got == [(2, 5), (2, 7), (2, 9), (5, 9), (7, 9)]
    clash = spark.createDataFrame([("ａ", 1, 2)], "text string, _text int, _c0 int")
    assert tuple(plain_text.with_plain_text(clash, "text").first()) == ("ａ", 1, 2, "a")
    assert plain_text.same_reading(asr(spark, [])).count() == 0
