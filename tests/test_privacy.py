"""Spans, entities, pseudonyms, masking and gates."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from turnwise.functions import pseudonyms as P
from turnwise.functions import similarity as S
from turnwise.functions import text as T
from turnwise.operators import anonymize, entities, pii, text_clean
from turnwise.sources import files, providers

SPAN = "doc_id bigint, start int, end int, entity_type string, score double, source string, ord bigint"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("seconds,expected", [(0.0005, "00:00:00,000"), (0.0015, "00:00:00,002"), (59.9995, "00:01:00,000"), (3599.9996, "01:00:00,000"), (360000.25, "100:00:00,250")])
def test_srt_time(spark, seconds, expected):
    assert one(spark, T.srt_time, seconds, "double") == expected


def test_texts(spark):
    assert one(spark, T.without_stutter, "re-re-regarde la-la porte") == "re-regarde la porte"
    assert one(spark, T.dialogue_spacing, " a , b!c 3.5 ...") == "a, b! c 3. 5. . ."
    assert one(spark, T.clean_text, "bonjour , c' est l'heure!on y va") == "Bonjour, c’est l’heure! On y va"
    assert one(spark, T.folded_punctuation, "Dr Martin – l’été") == "Dr Martin - l'été"
    assert one(spark, T.sentences, "Un. Deux?  Trois!\n quatre") == ["Un.", "Deux?", "Trois!", "quatre"]
    assert one(spark, T.word_count, " a  b c ") == 3 and one(spark, T.word_count, None) == 0
    assert one(spark, T.speaker_index, "spk3") == 3 and one(spark, T.speaker_index, "x") == 0
    assert one(spark, T.path_component, "a b/c?.wav") == "a_b_c_.wav"


def test_disjoint_and_longest(spark):
    rows = [(1, 0, 5, "PER", 0.5, "ner", 0), (1, 0, 9, "ORG", 0.9, "ner", 1), (1, 4, 20, "LOC", 1.0, "regex", 2), (1, 20, 22, "PER", 0.1, "ner", 3), (1, 0, 5, "PER", 0.9, "ner", 9)]
    df = spark.createDataFrame(rows, SPAN)
    assert [(r.start, r.end) for r in pii.disjoint_spans(df).orderBy("start").collect()] == [(0, 9), (20, 22)]
    assert [(r.start, r.end) for r in pii.longest_spans(df).orderBy("start").collect()] == [(4, 20), (20, 22)]


def test_speaker_label_and_line_end(spark):
    """A label's span is dropped, a name right before the next line's label is kept."""
    text = "SPEAKER_1 : voici Martin\nSPEAKER_2 : oui"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    at = text.index("Martin")
    spans = spark.createDataFrame([(1, 0, 7, "PER", 0.9, "ner", 0), (1, at, at + 6, "PER", 0.9, "ner", 1)], SPAN)
    assert [r.surface for r in anonymize.resolved(pii.with_context(spans, docs)).collect()] == ["Martin"]


def test_digest(spark):
    for label, key in (("PERSON", "Élise Œuvre"), ("X", "a b")):
        folded = key.strip().lower().translate(str.maketrans(P.ACCENTS, P.PLAIN)).replace("œ", "oe")
        d = int(hashlib.sha256(f"{label}:{folded}".encode()).hexdigest(), 16)
        h = P.pieces(P.digest(F.lit(label), F.lit(key)))
        got = spark.range(1).select(P.remainder(h, 23), P.remainder(h, 10**9), P.remainder(h, 10**14), P.remainder(h, 10**23), P.quotient_remainder(h, 13, 20)).first()
        assert [int(x) for x in got] == [d % 23, d % 10**9, d % 10**14, d % 10**23, (d // 13) % 20]


def test_pseudonyms_are_unique(spark):
    rows = [(1, "LOCATION", f"ville {i}", i) for i in range(400)] + [(1, "LOCATION", "VILLE 3", 900), (2, "LOCATION", "ville 3", 0)]
    got = P.pseudonyms(spark.createDataFrame(rows, "scope int, label string, key string, first_pos int")).collect()
    mine = [r.pseudonym for r in got if r.scope == 1 and r.key != "VILLE 3"]
    assert len(mine) == len(set(mine)) == 400
    by = {(r.scope, r.key): r.pseudonym for r in got}
    assert by[1, "VILLE 3"] == by[1, "ville 3"]


def test_similarity():
    assert S.ratio("abc", "abc") == 100 and round(S.ratio("abcd", "abxd"), 4) == 75
    assert S.partial_ratio("martin", "jean martin") == 100
    assert S.token_sort_ratio("martin jean", "jean martin") == 100 and S.token_set_ratio("jean", "jean martin") == 100


def test_clusters(spark):
    names = [(1, 0, "Martin", "PERSON"), (1, 10, "martin", "PERSON"), (1, 20, "Martins", "PERSON"), (1, 30, "Dupont", "PERSON"), (1, 40, "Dupond", "PERSON"), (1, 50, "Novalis", "ORGANIZATION")]
    df = spark.createDataFrame([(*n, 0.9, "x") for n in names], "doc_id bigint, start int, surface string, label string, score double, source string")
    got = {r.surface: (r.label, r.entity, r.canonical) for r in entities.entity_clusters(df).collect()}
    assert got["Martin"] == got["martin"] == got["Martins"] == ("PERSON", 1, "Martin")
    assert got["Dupont"] == got["Dupond"] and got["Dupont"][1] == 2 and got["Novalis"][1] == 1


def _plain_close(a, b):
    """The rule as it is stated: every ratio of every pair."""
    best = max(S.ratio(a[0], b[0]), S.partial_ratio(a[0], b[0]), S.token_set_ratio(a[1], b[1]), S.token_sort_ratio(a[1], b[1])) if a[0] and b[0] else 0
    return best >= 92 or (best >= 80 and a[0][0] == b[0][0] and abs(len(a[0]) - len(b[0])) <= 3)


def test_close_and_nearby_are_the_plain_rule():
    rng = random.Random(7)
    for letters in ("ab", "abc1", "0123456789", "abcdefghij"):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 5, 9, 14])))
        names = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 9]))) for _ in range(25)] + ["", letters * 40]
        names += ["".join(c if rng.random() < 0.9 else rng.choice(letters + " ") for c in n) for n in names for _ in range(2)]
        of = [entities.keys(n) for n in names]
        nearby = entities.Nearby()
        for at, key in [*enumerate(reversed(of)), *enumerate(of)]:  # a group's key may change
            nearby.put(at, key)
        for q in of:
            want = [i for i, k in enumerate(of) if _plain_close(k, q)]
            assert [i for i, k in enumerate(of) if entities.close(k, q)] == want
            assert set(want) <= {*nearby.able(q, 0, 30), *nearby.able(q, 30, len(of))}


def test_many_groups_are_those_of_every_pair(monkeypatch):
    """A recording with very many numbers takes seconds (before, 600 of 600 mails took two minutes); same groups by either way."""
    rng = random.Random(3)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.choice([10, 14, 20]))) for _ in range(1500)]
    spaced = [" ".join(n[i : i + 2] for i in range(0, len(n), 2)) if k % 3 == 0 else n for k, n in enumerate(numbers)]
    mentions = [(i, s, 0.9, "x") for i, s in enumerate(spaced)]
    began = time.process_time()
    many = entities.group_mentions(mentions, "PHONE")
    assert time.process_time() - began < 30 and len(many) > 500
    some = entities.group_mentions(mentions[:250], "PHONE")
    monkeypatch.setattr(entities, "MANY", 1 << 30)
    assert entities.group_mentions(mentions[:250], "PHONE") == some


def test_spans_are_detected_once(spark):
    """One label a surface without a second reading of the texts."""
    docs = spark.createDataFrame([(1, "avec Novalis. Novalis, 01 23 45 67 89, a@b.fr"), (None, "avec Novalis")], "doc_id bigint, text string")
    found = anonymize.resolved(pii.detected(docs, [("Novalis", "ORG")]), [("Novalis", "ORG")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("found(text") == 1
    assert sorted((r.doc_id, r.surface, r.label) for r in found.collect()) == [(1, "01 23 45 67 89", "PHONE"), (1, "Novalis", "ORGANIZATION"), (1, "Novalis", "ORGANIZATION"), (1, "a@b.fr", "EMAIL")]


def test_roundtrip(spark):
    docs = spark.createDataFrame([(1, "Jean Martin écrit à Novalis, tel 01 23 45 67 89."), (2, "rien ici"), (3, None)], "doc_id bigint, text string")
    masked, mapping = anonymize.anonymized(docs, [("Jean Martin", "PERSON"), ("Novalis", "ORG")])
    rows = {r.doc_id: r for r in masked.collect()}
    assert "Martin" not in rows[1].masked and "Novalis" not in rows[1].masked and rows[2].masked == "rien ici" and rows[3].masked is None
    back = {r.doc_id: r.text for r in anonymize.unmasked(masked, mapping).collect()}
    assert back[1] == rows[1].text


def test_restore_is_one_pass(spark):
    docs = spark.createDataFrame([(1, "A et B, Abc")], "doc_id bigint, text string")
    keys = spark.createDataFrame([(1, "A", "B"), (1, "B", "C")], "doc_id bigint, key string, value string")
    assert entities.restored(docs, keys).first().text == "B et C, Abc"


def test_gate(spark):
    ok = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text_clean.passes_gate(F.col("a"), F.col("b"))).first()[0]
    base = "SPEAKER_1: un deux trois quatre"
    assert ok(base, "SPEAKER_1: Un, deux, trois, quatre.") and ok(base, "SPEAKER_1 : Un deux trois quatre")
    assert not ok(base, "SPEAKER_2: Un deux trois quatre") and not ok(base, "SPEAKER_1: un") and not ok(base, "1. SPEAKER_1: un deux trois quatre")
    assert not ok("un deux trois", "Voici un deux trois")


def test_cleanup(spark):
    assert one(spark, text_clean.local_cleanup, "SPEAKER_1: bonjour , ça va ?SPEAKER_2: oui") == "SPEAKER_1: bonjour, ça va?\nSPEAKER_2: oui\n"
    assert one(spark, text_clean.forced_capitals, "SPEAKER_1: bonjour. oui\nx") == "SPEAKER_1: Bonjour. Oui\nx\n"
    assert one(spark, text_clean.small_connectives, "SPEAKER_1: oui, Et non") == "SPEAKER_1: oui, et non\n"


def test_chunks():
    text = "SPEAKER_1 : " + "Bonjour. " * 60 + "SPEAKER_2 : " + "x" * 300
    for limit in (40, 100, 1000):
        assert "".join(text_clean.smart_chunks(text, limit)) == text
    assert text_clean.line_chunks("a\nb\nc", chars=4) == ["a\nb", "c"]
    assert text_clean.without_repeats("a\nb\nc\na\nb\nc\nd", 3, 1) == "a\nb\nc\nd"
    assert [b[2] for b in text_clean.sentence_blocks("A. B. C. D. E. F.")] == ["A. B. C. D. E.", "F."]


def test_mappings(spark):
    kind = "scope int, tag string, label string, canonical string"
    base = spark.createDataFrame([(1, "<PERSON_1>", "PERSON", "A"), (1, "<PERSON_3>", "PERSON", "B")], kind)
    extra = spark.createDataFrame([(1, "<PERSON_1>", "PERSON", "A"), (1, "<PERSON_2>", "PERSON", "C")], kind)
    got = {(r.tag, r.canonical) for r in entities.merged_mappings(base, extra).collect()}
    assert got == {("<PERSON_1>", "A"), ("<PERSON_3>", "B"), ("<PERSON_4>", "A"), ("<PERSON_2>", "C")}


def test_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"pattern": "Nova", "label": "org"}, {"text": "Lyra"}, {"label": ""}]))
    (tmp_path / "b.json").write_text(json.dumps({"Nova": "LOC"}))
    (tmp_path / "c.txt").write_text("Nova\n\n Lyra \n")
    read = lambda n: sorted((r.pattern, r.label) for r in files.catalog(spark, str(tmp_path / n)).collect())
    assert read("a.json") == [("Lyra", "CAT"), ("Nova", "ORG")] and read("b.json") == [("Nova", "LOC")] and read("c.txt") == [("Lyra", "CAT"), ("Nova", "CAT")]


def test_files_and_providers(spark, tmp_path):
    (tmp_path / "run" / "txt").mkdir(parents=True)
    (tmp_path / "run" / "txt" / "a.txt").write_text("x")
    (tmp_path / "run" / "manifest.json").write_text("{}")
    (tmp_path / "run" / "b.webm").write_bytes(b"abc")
    rows = {r.path: (r.name, r.category) for r in files.artifacts(spark, str(tmp_path / "run")).collect()}
    assert rows == {"txt/a.txt": ("a.txt", "txt"), "b.webm": ("b.webm", "")}
    audio = files.audio_files(spark, str(tmp_path / "run"), with_content=True)
    empty = spark.createDataFrame([("x", b"")], "path string, content binary")
    got = providers.provided(audio.select("path", "content").unionByName(empty), "test", providers.transcoder, "path string, sample_rate int, channels int, digest string").collect()
    assert sorted(bool(r.error) for r in got) == [False, True]


def test_reply_spans(spark):
    reply = '[{"start": 1, "end": 4, "type": "per"}, {"start": 5, "end": 5, "type": "PER"}, {"start": 2, "end": 3, "type": "X"}]'
    assert [(s.start, s.end, s.entity_type) for s in one(spark, files.reply_spans, reply)] == [(1, 4, "PER")]
    assert one(spark, files.reply_spans, "no json") == []


def test_live(spark, tmp_path):
    from turnwise.streaming.live import live_sessions

    rows = [(1, 0, "2024-01-01 00:00:00", "2024-01-01 00:00:01"), (1, 0, "2024-01-01 00:00:01.1", "2024-01-01 00:00:02"), (1, 0, "2024-01-01 00:00:05", "2024-01-01 00:00:06"), (1, 0, "2024-01-01 01:00:00", "2024-01-01 01:00:01")]
    df = spark.createDataFrame(rows, "rec_id int, speaker int, a string, b string").select("rec_id", "speaker", F.col("a").cast("timestamp").alias("start_ts"), F.col("b").cast("timestamp").alias("end_ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = live_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("live").collect()) == [1, 2]


def test_catalog_scan():
    scan = pii.catalog_scan([("Ana", "PER"), ("ana na", "X"), ("rue", "LOC")], True, 1.0, "domain")
    assert scan("Ana, anana ANA na Rue la rue") == [(0, 3, "PER", 1.0, "domain"), (11, 14, "PER", 1.0, "domain"), (11, 17, "X", 1.0, "domain"), (18, 21, "LOC", 1.0, "domain")]
    loose = pii.catalog_scan([("ana", "PER")], False, 0.95, "catalog", as_person=True)
    assert [s[:3] for s in loose("anana ANA")] == [(0, 3, "PERSON"), (6, 9, "PERSON")]
    assert pii.catalog_scan([], False, 1.0, "x")("abc") == []


def test_tolerant_restore():
    assert entities.restored_tolerantly("ELISE et élise, Elisette", {"Élise": "\\1 Zoé"}) == "\\1 Zoé et \\1 Zoé, Elisette"
    assert entities.restored_tolerantly(None, {"a": "b"}) is None and entities.restored_tolerantly("x", {}) == "x"


def test_titled_end_and_sweep():
    text = "Conseil NovaLyra de Brest et plus"
    assert text[: text_clean.titled_end(text, 7)] == "Conseil NovaLyra de Brest"
    ask = lambda window: [(m.start(), m.end(), "PER") for m in __import__("re").finditer("Zoé", window)]
    body = "a Zoé b " * 30
    masked, new = text_clean.swept(body, [(0, 100), (100, 240)], ["<PER_7>"], ask)
    assert masked == "".join(f"a <PER_{n}> b " for n in found_order(masked)) and len(new) == 30 and sorted(int(t[5:-1]) for t, *_ in new) == list(range(8, 38))

    def fails(window):
        raise OSError

    assert text_clean.swept(body, [(0, 100)], [], fails) == (body, [])


def found_order(masked):
    return [int(n) for n in __import__("re").findall(r"<PER_(\d+)>", masked)]


def test_domain_type_and_canonical(spark):
    """The domain's type and form win; words of the lists drop spans, the persons' list persons only."""
    docs = spark.createDataFrame([(1, "Hier NOVA LYRA a écrit, puis Nova Lyra; Merci Jean et Relance Nord et la nova lyra fragile.")], "doc_id bigint, text string")
    text = docs.first().text
    span = lambda s, kind, k=0: (1, (a := [m.start() for m in __import__("re").finditer(s, text)][k]), a + len(s), kind, 0.9, "ner", a)
    model = spark.createDataFrame([span("NOVA LYRA", "PER"), span("Merci Jean", "PER"), span("Relance Nord", "ORG")], SPAN)
    found = anonymize.resolved(pii.detected(docs, [("Nova Lyra", "ORG")], model), [("Nova Lyra", "ORG")])
    got = sorted((r.start, r.surface, r.label) for r in found.collect())
    assert got == [(5, "NOVA LYRA", "ORGANIZATION"), (text.index("Nova Lyra"), "Nova Lyra", "ORGANIZATION")]
    assert {r.canonical for r in entities.entity_clusters(found, {"nova lyra": "Nova Lyra"}).collect()} == {"Nova Lyra"}


def test_masks_by_block(spark):
    docs = spark.createDataFrame([(1, "a Zoé  b x@y.fr Zoé"), (2, None), (3, "")], "doc_id bigint, text string")
    model = spark.createDataFrame([(1, 1, 6, "B-PER", 0.9, "ner", 0), (1, 16, 19, "PER", 0.7, "ner", 1), (1, 2, 5, "ORG", 0.5, "ner", 2), (1, 6, 7, "LOC", 0.9, "ner", 3)], SPAN)
    masked, tags = pii.numbered_masks(docs, pii.block_spans(docs, model))
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "a <PER_2>  b <EMAIL_1> <PER_1>", 2: None, 3: ""}
    assert sorted((r.tag, r.original) for r in tags.collect()) == [("<EMAIL_1>", "x@y.fr"), ("<PER_1>", "Zoé"), ("<PER_2>", "Zoé")]


def test_corrected_dialogues(spark):
    docs = spark.createDataFrame([(1, "SPEAKER_1: oui  oui\nSPEAKER_2: non"), (2, "SPEAKER_1: un, Et deux. trois"), (3, ""), (4, None)], "doc_id bigint, text string")

    def factory():
        return lambda row: [{"text": row["text"].replace("  ", " ") if "non" in row["text"] else "Voici un texte"}]

    got = {r.doc_id: (r.text, r.by_model) for r in text_clean.corrected_dialogues(docs, factory, "test-corrector").collect()}
    assert got[1] == ("SPEAKER_1: oui oui\nSPEAKER_2: non\n", True) and got[2] == ("SPEAKER_1: Un, et deux. Trois\n", False)
    assert got[3] == ("\n", False) and got[4] == (None, False)


def test_lines_and_repeats_by_hand():
    """The packing and trimming rules as plain loops."""
    import random

    rng = random.Random(4)

    def packed(rows, chars, lines):
        out, held = [], []
        for row in rows:
            if held and (sum(map(len, held)) + len(held) + len(row) + 1 > chars or len(held) == lines):
                out.append("\n".join(held))
                held = []
            held.append(row)
        return [*out, "\n".join(held)] if held else out

    for _ in range(200):
        rows = ["x" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 30))]
        chars, lines = rng.randrange(1, 30), rng.randrange(1, 6)
        if rows[-1]:
            assert text_clean.line_chunks("\n".join(rows), chars, lines) == packed(rows, chars, lines)
    for _ in range(300):
        rows, k, most = [rng.choice("ab") for _ in range(rng.randrange(0, 30))], rng.randrange(1, 4), rng.randrange(1, 3)
        kept, met = [], 0
        for row in rows:
            kept.append(row)
            met = met + 1 if len(kept) >= 2 * k and kept[-k:] == kept[-2 * k : -k] else 0
            if met == most:
                kept, met = kept[:-k], 0
        assert text_clean.without_repeats("\n".join(rows), k, most) == "\n".join(kept)


def test_restore_tolerates(spark):
    docs = spark.createDataFrame([(1, "ELISE  brun chez alizé, et <PERSON_1>")], "doc_id bigint, text string")
    keys = spark.createDataFrame([(1, "Élise Brun", "Ana Roux"), (1, "Alizé Conseil", "Novalis"), (1, "<PERSON_1>", "Ana Roux")], "doc_id bigint, key string, value string")
    assert entities.restored(docs, keys).first().text == "Ana Roux chez Novalis, et Ana Roux"
    assert one(spark, entities.label_of_tag, "<PERSON_12>") == "PERSON" and one(spark, entities.label_of_tag, "x") == ""


def test_report_blocks(spark):
    from turnwise.operators.turns import report_blocks

    docs = spark.createDataFrame([(1, "intro\nnext\n\n### Title \nbody\n### Two\r\n\nlast"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = [tuple(r) for r in report_blocks(docs).orderBy("doc_id", "block").collect()]
    assert got == [(1, 1, "paragraph", "intro next"), (1, 2, "heading", "Title"), (1, 3, "paragraph", "body"), (1, 4, "heading", "Two"), (1, 5, "paragraph", "last")]


def test_strict_texts(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é\r\nb".encode())
    assert files.strict_texts(spark, str(tmp_path / "a.md")).first().text == "é\nb"
    with pytest.raises(Exception):
        files.strict_texts(spark, str(tmp_path / "none.md")).collect()
