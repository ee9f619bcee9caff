"""Queries of the operators on personal data, entities and corrected texts, with SQL for each that SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import pseudonyms as names
from turnwise.functions.text import folded_punctuation, sentences
from turnwise.operators import anonymize, entities, pii, text_clean
from turnwise.plans import speech
from turnwise.sources import providers
from turnwise.sources.files import catalog_types as types_of
from turnwise.sources.tables import table

Q = DataFrame
#: Entries of the catalog that the scans take, at most: each task gets all of them.
CATALOG_LIMIT = 50_000


def _catalog(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    rows = table(spark, sf_dir, "entity_catalog").select(F.trim("pattern").alias("p"), F.upper(F.coalesce("entity_type", F.lit("CAT"))).alias("t")).where(F.length("p") > 0)
    found = rows.groupBy(F.lower("p")).agg(F.min(F.struct("p", "t")).alias("r")).select("r.*").orderBy("p").limit(CATALOG_LIMIT + 1).collect()
    if len(found) > CATALOG_LIMIT:
        raise ValueError(f"the catalog has more than {CATALOG_LIMIT} entries")
    return [tuple(r) for r in found]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments as documents."""
    asr = table(spark, sf_dir, "asr_segments").where(F.col("text").isNotNull())
    return asr.groupBy(_doc_id().alias("doc_id")).agg(F.min("text").alias("text"))


def _doc_id() -> Column:
    """One number for recording and segment; numbers that would run into another recording's raise an error."""
    sound = F.col("rec_id").between(0, (1 << 31) - 1) & F.col("seg_idx").between(0, (1 << 32) - 1)
    packed = F.col("rec_id") * F.lit(1 << 32) + F.col("seg_idx")
    return F.when(F.coalesce(sound, F.lit(True)), packed).otherwise(F.raise_error(F.lit("rec_id or seg_idx beyond a document's number")).cast("bigint"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of their users' documents."""
    start = F.pmod(F.col("event_id") * 37, F.lit(5000)).cast("int")
    kind = F.upper("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), start.alias("start"), (start + F.length("event_type")).alias("end"), kind.alias("entity_type"), F.round("value", 2).alias("score"),
        F.concat(F.lit("s"), F.pmod(F.col("event_id"), F.lit(3))).alias("source"), F.col("event_id").alias("ord"), F.concat("event_type", F.lit("-"), F.pmod(F.col("event_id"), F.lit(11))).alias("surface"),
    )


def pii_counts(spark: SparkSession, sf_dir: str) -> Q:
    return pii.structured_counts(table(spark, sf_dir, "documents"))


def pii_values(spark: SparkSession, sf_dir: str) -> Q:
    asr = table(spark, sf_dir, "asr_segments").where(F.col("text").contains("@"))
    found = asr.select(F.explode(F.regexp_extract_all("text", F.lit(pii.EMAIL.replace(r"\b", "")), F.lit(0))).alias("value"))
    return found.groupBy(F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def pii_spans(spark: SparkSession, sf_dir: str) -> Q:
    entries = _catalog(spark, sf_dir)
    return anonymize.resolved(pii.detected(_texts(spark, sf_dir), entries), entries)


_PLACED = ["doc_id", "start", "end", "entity_type"]


def catalog_hits(spark: SparkSession, sf_dir: str) -> Q:
    return pii.spans_of(_texts(spark, sf_dir), pii.catalog_scan(_catalog(spark, sf_dir), False, 0.95, "catalog")).select(*_PLACED)


def domain_hits(spark: SparkSession, sf_dir: str) -> Q:
    return pii.spans_of(_texts(spark, sf_dir), pii.catalog_scan(_catalog(spark, sf_dir), True, 1.0, "domain")).select(*_PLACED)


def context_hits(spark: SparkSession, sf_dir: str) -> Q:
    return pii.spans_of(_texts(spark, sf_dir), pii.context_scan()).select(*_PLACED, "score", "source", "surface")


def model_spans(spark: SparkSession, sf_dir: str) -> Q:
    """A model's spans through the gate of scores; the catalog's entries stand in for the model, with scores by their place."""
    docs = _texts(spark, sf_dir)
    hits = pii.spans_of(docs, pii.catalog_scan(_catalog(spark, sf_dir), True, 1.0, "ner"))
    raw = hits.withColumn("score", F.pmod(F.col("start") + F.col("end"), F.lit(100)) / 100)
    return pii.ner_gate(raw).select(*_PLACED, "score")


def block_masks(spark: SparkSession, sf_dir: str) -> Q:
    """Model, pattern and catalog spans of each text as one set, and the text with a numbered tag for each."""
    docs = _texts(spark, sf_dir)
    wide = text_clean.with_titled_ends(pii.spans_of(docs, pii.context_scan()), docs)
    masked, tags = pii.numbered_masks(docs, pii.block_spans(docs, wide, _catalog(spark, sf_dir)))
    counts = tags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tags"))
    return masked.join(counts, "doc_id").withColumnRenamed("text", "masked")


def swept_masks(spark: SparkSession, sf_dir: str) -> Q:
    """Masked texts looked through again by a stand-in for a model, which finds places introduced by a preposition."""
    docs = _texts(spark, sf_dir)
    masked, tags = pii.numbered_masks(docs, pii.block_spans(docs, pii.spans_of(docs, pii.context_scan())))
    own = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    rows = docs.join(masked.withColumnRenamed("text", "masked"), "doc_id").join(own, "doc_id", "left")
    return text_clean.model_sweep(rows, providers.place_finder()).select("doc_id", "masked", F.size("added").alias("n_added"))


def catalog_types(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "entity_catalog").select("pattern", F.col("entity_type").alias("label"))
    return types_of(rows).select("label", F.array_join("values", "|").alias("values"))


def pii_label_resolution(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "entity_catalog").select(
        F.lit(1).cast("long").alias("doc_id"), F.trim("pattern").alias("surface"), pii.entity_type(F.coalesce("entity_type", F.lit(""))).alias("entity_type"), (F.pmod("entry_no", F.lit(5)) / 10).alias("score"), F.col("entry_no").cast("long").alias("ord")
    )
    return pii.best_labels(rows.where(F.length("surface") > 0))


def pseudonyms(spark: SparkSession, sf_dir: str) -> Q:
    key = lambda t, c, label, base: table(spark, sf_dir, t).select(F.lit(1).alias("scope"), F.lit(label).alias("label"), F.col(c).alias("key"), (F.col(base[0]) + base[1]).cast("long").alias("first_pos"))
    keys = key("customer", "c_name", "PERSON", ("c_custkey", 0)).unionByName(key("supplier", "s_name", "ORGANIZATION", ("s_suppkey", 10**9))).unionByName(key("nation", "n_name", "LOCATION", ("n_nationkey", 2 * 10**9)))
    return names.pseudonyms(keys)


def pseudonym_forms(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "customer").select("c_name")
    forms = [(k, names.candidate(F.lit(k), F.col("c_name")).alias(k.lower())) for k in ("PHONE", "EMAIL", "IBAN", "SIREN", "SIRET", "DATE", "URL", "OTHER")]
    return rows.select("c_name", *[c for _, c in forms])


def span_tags(spark: SparkSession, sf_dir: str) -> Q:
    return pii.backward_tags(_marks(spark, sf_dir)).select("doc_id", "start", "ord", "tag")


def entity_stats(spark: SparkSession, sf_dir: str) -> Q:
    marks = _marks(spark, sf_dir)
    return entities.entity_stats(marks.withColumn("tag", F.concat("entity_type", F.pmod("ord", F.lit(4)).cast("string"))))


def tag_mapping(spark: SparkSession, sf_dir: str) -> Q:
    marks = _marks(spark, sf_dir).withColumn("tag", F.concat(F.lit("<"), "entity_type", F.lit("_"), F.pmod("ord", F.lit(4)), F.lit(">")))
    rows = entities.tag_mapping(marks.withColumn("score", F.lit(0.5)).withColumn("start", F.col("ord")))
    return rows.select("doc_id", "tag", "type", "canonical", F.array_join("mentions", "|").alias("mentions"), F.array_join("sources", "|").alias("sources"), "score_avg")


def disjoint_spans(spark: SparkSession, sf_dir: str) -> Q:
    return pii.disjoint_spans(_marks(spark, sf_dir))


def longest_spans(spark: SparkSession, sf_dir: str) -> Q:
    return pii.longest_spans(_marks(spark, sf_dir))


def merged_mappings(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "entity_catalog").select(F.lit(1).alias("scope"), F.coalesce(F.upper("entity_type"), F.lit("CAT")).alias("label"), F.trim("pattern").alias("canonical"), "entry_no")
    n = lambda key: F.row_number().over(Window.partitionBy("label").orderBy(key))
    tag = lambda key: F.concat(F.lit("<"), "label", F.lit("_"), n(key), F.lit(">"))
    side = lambda rest: rows.where(F.pmod("entry_no", F.lit(2)) == rest).withColumn("tag", tag("entry_no")).drop("entry_no")
    return entities.merged_mappings(side(0), side(1))


def merged_stats(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "entity_catalog").select(F.lit(1).alias("scope"), F.coalesce(F.upper("entity_type"), F.lit("CAT")).alias("label"), "entry_no")
    count = lambda rest: rows.where(F.pmod("entry_no", F.lit(2)) == rest).groupBy("scope", "label").agg(F.count(F.lit(1)).alias("n"))
    return entities.merged_stats(count(0), count(1))


def merged_lookups(spark: SparkSession, sf_dir: str) -> Q:
    rows = table(spark, sf_dir, "entity_catalog").where(F.length(F.trim("pattern")) > 0)
    key = F.lower(F.trim("pattern"))
    side = lambda rest: rows.where(F.pmod("entry_no", F.lit(2)) == rest).groupBy(F.lit(1).alias("scope"), key.alias("key")).agg(F.min("entry_no").alias("value"))
    return entities.merged_lookups(side(0), side(1))


def entity_clusters(spark: SparkSession, sf_dir: str) -> Q:
    """Entities of whole recordings, from the spans of all segments."""
    entries = _catalog(spark, sf_dir)
    spans = anonymize.resolved(pii.detected(_texts(spark, sf_dir), entries), entries)
    of = spans.select(F.shiftright("doc_id", 32).alias("doc_id"), (F.col("doc_id").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(1 << 20) + F.col("start")).alias("start"), "surface", "label", "score", "source")
    return entities.entity_clusters(of, {k: p for k, (p, _) in anonymize.domain_labels(entries).items()})


def anonymize_roundtrip(spark: SparkSession, sf_dir: str) -> Q:
    masked, mapping = anonymize.anonymized(_texts(spark, sf_dir), _catalog(spark, sf_dir))
    back = anonymize.unmasked(masked, mapping).withColumnRenamed("text", "restored")
    joined = masked.join(back, "doc_id").where("n_spans > 0")
    return joined.select("doc_id", "masked", "restored", (F.lower("restored") == F.lower("text")).alias("same"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the text two segments later, as an original and its correction; a recording's last two have none.

    Windows run inside blocks of 500 seg_idx; a block's last two rows take theirs from the first rows of the blocks after it.
    """
    asr = table(spark, sf_dir, "asr_segments").groupBy("rec_id", "seg_idx").agg(F.min("text").alias("text"))
    told = F.concat(F.lit("SPEAKER_"), F.pmod("seg_idx", F.lit(2)), F.lit(": "), F.coalesce("text", F.lit("")))
    # As a struct the block is never null: the join filters neither side, and both read the same shuffles.
    block = F.struct("rec_id", F.floor(F.col("seg_idx") / 500).alias("no"))
    inside, blocks = Window.partitionBy("block").orderBy("seg_idx"), Window.partitionBy("block.rec_id").orderBy("block.no")
    rows = asr.select("seg_idx", block.alias("block"), told.alias("told"))
    placed = rows.select("*", F.lead("told").over(inside).alias("second"), F.lead("told", 2).over(inside).alias("third"), F.row_number().over(inside).alias("n"))
    # The first two texts after the block; a block of one row leaves the second to the block after it.
    after = F.lead("told").over(blocks), F.coalesce(F.lead("second").over(blocks), F.lead("told", 2).over(blocks))
    heads = placed.where("n = 1").select("block", after[0].alias("after_1"), after[1].alias("after_2"))
    corrected = F.coalesce("third", F.when(F.col("second").isNull(), F.col("after_2")).otherwise(F.col("after_1")))
    return placed.join(heads, "block", "left").select("block.rec_id", "seg_idx", F.col("told").alias("original"), corrected.alias("corrected"))


def llm_gate(spark: SparkSession, sf_dir: str) -> Q:
    o, c = F.col("original"), F.col("corrected")
    return _pairs(spark, sf_dir).where(c.isNotNull()).select("rec_id", "seg_idx", text_clean.passes_gate(o, c).alias("passes"), text_clean.same_structure(o, c).alias("same"))


def text_cleanup(spark: SparkSession, sf_dir: str) -> Q:
    """Every segment's text, with its partner where it has one."""
    whole = text_clean.local_cleanup(F.concat_ws(" ", "original", "corrected"))
    return _pairs(spark, sf_dir).select("rec_id", "seg_idx", text_clean.small_connectives(text_clean.forced_capitals(whole)).alias("text"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> Q:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    tidy = folded_punctuation(F.col("text"))
    return docs.select("doc_id", F.md5(tidy).alias("digest"), F.length(tidy).alias("n_chars"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> Q:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.size(sentences(F.col("text"))).alias("n_sentences"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> Q:
    """Every chunk of each document, by way of packing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    smart = text_clean.listed(lambda t: text_clean.smart_chunks(t, 800))
    lines = text_clean.listed(text_clean.line_chunks)
    blocks = text_clean.listed(text_clean.sentence_blocks, "array<struct<start:int,end:int,text:string>>")
    piece = lambda way, c: docs.select("doc_id", F.lit(way).alias("way"), F.posexplode(c).alias("no", "piece"))
    return piece("smart", smart("text")).unionByName(piece("lines", lines("text"))).unionByName(piece("sentences", F.transform(blocks("text"), lambda x: x["text"])))


def dedupe_runs(spark: SparkSession, sf_dir: str) -> Q:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", "text").alias("text"))
    return docs.select("doc_id", text_clean.deduplicated("text").alias("text"))


def dialogue_correction(spark: SparkSession, sf_dir: str) -> Q:
    """Dialogues of all recordings through the stand-in for a correcting model, its gates and the rules it falls back to."""
    docs = speech.dialogue_files(spark, sf_dir).select(F.col("rec_id").alias("doc_id"), F.col("dialogue").alias("text"))
    return text_clean.corrected_dialogues(docs, providers.corrector)


QUERIES = {
    f.__name__: f
    for f in (
        pii_counts, pii_values, pii_spans, catalog_hits, domain_hits, context_hits, model_spans, block_masks, swept_masks, catalog_types, pii_label_resolution, pseudonyms, pseudonym_forms, span_tags, entity_stats, tag_mapping, disjoint_spans, longest_spans,
        merged_mappings, merged_stats, merged_lookups, entity_clusters, anonymize_roundtrip, llm_gate, text_cleanup, normalized_texts, sentence_counts, chunk_pack, dedupe_runs, dialogue_correction,
    )
}

_EMAIL = pii.EMAIL.replace(r"\b", "")
_TYPE = lambda c: (
    f"CASE WHEN {c} IN ('PER', 'PERSON') THEN 'PERSON' WHEN {c} IN ('ORG', 'ORGANIZATION', 'COMPANY') THEN 'ORGANIZATION' WHEN {c} IN ('LOC', 'LOCATION', 'GPE') THEN 'LOCATION' ELSE 'MISC' END"
)
_FOLDED = f"translate(lower(trim(%s)), '{names.ACCENTS}', '{names.PLAIN}')"
_DIGEST = lambda label, key: f"sha256('{label}:' || {_FOLDED % key})"


def _mod(digest: str, n: int) -> str:
    """The digest modulo ``n``, folded over 32-bit pieces."""
    out = "0::HUGEINT"
    for k in range(8):
        out = f"(({out} * 4294967296 + CAST('0x' || substr({digest}, {8 * k + 1}, 8) AS BIGINT)) % {n}::HUGEINT)"
    return out


_PICK = lambda values, at: f"list_extract([{', '.join(repr(v) for v in values)}], CAST({at} AS INTEGER) + 1)"
_DIV = lambda d, a, b: f"({_mod(d, a * b)} // {a})"
_P = names.Pools()
_PAD = lambda v, n: f"lpad(CAST({v} AS VARCHAR), {n}, '0')"
_GROUP = lambda v, n: f"trim(regexp_replace({v}, '(.{{{n}}})', '\\1 ', 'g'))"
_MARKS = """marks AS (SELECT user_id AS doc_id, CAST((event_id * 37) % 5000 AS INTEGER) AS s, upper(event_type) AS entity_type, event_id AS ord, 's' || (event_id % 3) AS source, event_type || '-' || (event_id % 11) AS surface FROM events)"""
_SCORED = """scored AS (SELECT user_id AS doc_id, CAST((event_id * 37) % 5000 AS INTEGER) AS s, CAST((event_id * 37) % 5000 + length(event_type) AS INTEGER) AS e, upper(event_type) AS entity_type, round(value, 2) AS score,
  's' || (event_id % 3) AS source, event_id AS ord, event_type || '-' || (event_id % 11) AS surface FROM events)"""
_CATALOG = "c AS (SELECT lower(trim(pattern)) AS p, arg_min(upper(coalesce(entity_type, 'CAT')), (trim(pattern), upper(coalesce(entity_type, 'CAT')))) AS t FROM entity_catalog WHERE length(trim(pattern)) > 0 GROUP BY 1)"
_DOCS = "docs AS (SELECT rec_id * 4294967296 + seg_idx AS doc_id, min(text) AS text FROM asr_segments WHERE text IS NOT NULL GROUP BY 1)"
_WORDISH = lambda c: f"coalesce(regexp_matches({c}, '[\\p{{L}}\\p{{N}}_]'), false)"
_LIST = lambda words: "[" + ", ".join(repr(w) for w in sorted(words)) + "]"
_SMALL, _LETTERS = "'àâäçéèêëîïôöùûüÿñ', 'aaaceeeeiioouuuyn'", "'[a-zà-öø-ÿ' || chr(39) || ']+'"
_WHOLE_WORDS = f"""{_CATALOG}, {_DOCS}, hits AS (SELECT doc_id, t, p, text, lower(text) AS low FROM docs, c WHERE contains(lower(text), p)),
places AS (SELECT doc_id, t, p, text, low, unnest(range(1, length(low) + 1)) AS i FROM hits),
found AS (SELECT *, {_WORDISH("substr(low, i - 1, 1)")} AND i > 1 AS w0, {_WORDISH("substr(low, i, 1)")} AS w1, {_WORDISH("substr(low, i + length(p) - 1, 1)")} AS w2, {_WORDISH("substr(low, i + length(p), 1)")} AS w3,
  regexp_extract_all(translate(substr(low, greatest(1, i - 30), i - greatest(1, i - 30)), {_SMALL}), {_LETTERS}) AS before, regexp_extract_all(translate(substr(low, i + length(p), 30), {_SMALL}), {_LETTERS}) AS after
  FROM places WHERE substr(low, i, length(p)) = p),
whole AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(p) AS INTEGER) AS "end", t AS entity_type FROM found
  WHERE w0 <> w1 AND w2 <> w3 AND NOT (substr(text, i, length(p)) = lower(substr(text, i, length(p))) AND (coalesce(list_contains({_LIST(pii.DETERMINERS | pii.NOUNS)}, before[-1]), false)
    OR coalesce(list_contains({_LIST(pii.NOUNS)}, before[-2]), false) OR coalesce(list_contains({_LIST(pii.FOLLOWING)}, after[1]), false))))"""
_KEYS = f"""keys AS (
  SELECT 'PERSON' AS label, c_name AS key, c_custkey AS pos, {_PICK(_P.first, _mod('h', 23))} || ' ' || {_PICK(_P.last, _DIV('h', 13, 20))} AS c FROM (SELECT *, {_DIGEST('PERSON', 'c_name')} AS h FROM customer)
  UNION ALL SELECT 'ORGANIZATION', s_name, s_suppkey + 1000000000, {_PICK(_P.roots, _mod('h', 17))} || ' ' || {_PICK(_P.suffixes, _DIV('h', 7, 10))} FROM (SELECT *, {_DIGEST('ORGANIZATION', 's_name')} AS h FROM supplier)
  UNION ALL SELECT 'LOCATION', n_name, n_nationkey + 2000000000, {_PICK(_P.cities, _mod('h', 20))} FROM (SELECT *, {_DIGEST('LOCATION', 'n_name')} AS h FROM nation)),
own AS (SELECT label, {_FOLDED % 'key'} AS folded, min(pos) AS pos, any_value(c) AS c FROM keys GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos, label, folded) AS k, {_mod("sha256(label || ':' || folded)", 1000)} AS tail FROM own),
again AS (SELECT *, row_number() OVER (PARTITION BY c, tail, k > 50 ORDER BY pos, label, folded) AS r FROM ranked),
named AS (SELECT label, folded, CASE WHEN k = 1 THEN c WHEN k <= 50 THEN c || ' ' || k ELSE c || ' ' || {_PAD('tail', 3)} || CASE WHEN r > 1 THEN '-' || r ELSE '' END END AS pseudonym FROM again)"""
_GATE_TAGS = lambda c: f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, 'SPEAKER_[0-9]+ ?:'), lambda x: replace(x, ' ', ''))))"
_WORDS = lambda c: f"(CASE WHEN {speech._STRIP(c)} = '' THEN 0 ELSE len(string_split_regex({speech._STRIP(c)}, '{speech._S}+')) END)"
_LINE_TAGS = lambda c: f"regexp_extract_all({c}, '(?m)^({speech._S}*SPEAKER_[0-9]+ ?:{speech._S}*)', 1)"
_OPENING = " OR ".join(f"starts_with(lower(split_part(corrected, chr(10), 1)), '{w}')" for w in text_clean.OPENINGS)

SQL = {
    "pii_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?i){p}')) AS n_{k.lower()}" for k, p in pii.STRUCTURED.items()) + " FROM documents",
    "pii_values": f"SELECT lower(v) AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM asr_segments WHERE contains(text, '@')) GROUP BY 1",
    "catalog_types": f"""SELECT {_TYPE("upper(trim(coalesce(entity_type, '')))")} AS label, string_agg(DISTINCT trim(pattern), '|' ORDER BY trim(pattern)) AS "values" FROM entity_catalog WHERE length(trim(pattern)) > 0 GROUP BY 1""",
    "catalog_hits": f"""WITH {_CATALOG}, {_DOCS}, hits AS (SELECT doc_id, t, p, lower(text) AS low FROM docs, c WHERE contains(lower(text), p)),
places AS (SELECT doc_id, t, p, low, unnest(range(1, length(low) + 1)) AS i FROM hits)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(p) AS INTEGER) AS "end", t AS entity_type FROM places WHERE substr(low, i, length(p)) = p""",
    "domain_hits": f"WITH {_WHOLE_WORDS} SELECT * FROM whole",
    "model_spans": f"""WITH {_WHOLE_WORDS}, m AS (SELECT doc_id, start, "end", regexp_replace(entity_type, '^[BI]-', '') AS entity_type, ((start + "end") % 100) / 100 AS score FROM whole)
SELECT * FROM m WHERE score >= CASE WHEN entity_type IN ('PER', 'PERSON', 'ORG', 'LOC') THEN 0.65 ELSE 0.7 END""",
    "disjoint_spans": f"""WITH RECURSIVE {_SCORED}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, -score, ord) AS n FROM scored),
k AS (SELECT doc_id, n, s, e FROM m WHERE n = 1
UNION ALL SELECT x.doc_id, min(x.n), arg_min(x.s, x.n), arg_min(x.e, x.n) FROM k JOIN m x ON x.doc_id = k.doc_id AND x.s >= k.e GROUP BY x.doc_id)
SELECT m.doc_id, m.s AS start, m.e AS "end", entity_type, score, source, ord, surface FROM m JOIN k ON m.doc_id = k.doc_id AND m.n = k.n""",
    "longest_spans": f"""WITH RECURSIVE {_SCORED}, one AS (SELECT * EXCLUDE (c) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, entity_type ORDER BY ord, score, source) AS c FROM scored) WHERE c = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, s - e, CASE WHEN source = 'regex' THEN 0 ELSE 1 END, -score, ord) AS n FROM one),
k AS (SELECT doc_id, n, s, e, [n] AS kept FROM m WHERE n = 1
UNION ALL SELECT x.doc_id, x.n, CASE WHEN x.s >= k.e OR x.e - x.s > k.e - k.s THEN x.s ELSE k.s END, CASE WHEN x.s >= k.e OR x.e - x.s > k.e - k.s THEN x.e ELSE k.e END,
  CASE WHEN x.s >= k.e THEN list_append(kept, x.n) WHEN x.e - x.s > k.e - k.s THEN list_append(kept[:-2], x.n) ELSE kept END FROM k JOIN m x ON x.doc_id = k.doc_id AND x.n = k.n + 1),
last AS (SELECT doc_id, unnest(arg_max(kept, n)) AS n FROM k GROUP BY doc_id)
SELECT m.doc_id, m.s AS start, m.e AS "end", entity_type, score, source, ord FROM m JOIN last ON m.doc_id = last.doc_id AND m.n = last.n""",
    "normalized_texts": r"""WITH t AS (SELECT doc_id, regexp_replace(translate(text, '‐‑‒–−’‘', '-----' || chr(39) || chr(39)), '\b(Mme|Mlle|Me|Ma(?:ître|itre)|Dr|Pr|M\.)\s?([A-ZÀ-ÖØ-Þ])', '\1 \2', 'g') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(x) AS digest, CAST(length(x) AS INTEGER) AS n_chars FROM t""",
    "sentence_counts": f"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.?!\n]){speech._S}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{speech._S}+', '', 'g') <> '')) AS INTEGER) AS n_sentences FROM documents WHERE text IS NOT NULL""",
    "pii_label_resolution": f"""WITH r AS (SELECT lower(trim(pattern)) AS s, {_TYPE("upper(trim(coalesce(entity_type, '')))")} AS t, (entry_no % 5) / 10 AS score, entry_no FROM entity_catalog WHERE length(trim(pattern)) > 0)
SELECT CAST(1 AS BIGINT) AS doc_id, s AS surface_lower, t AS label FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE t WHEN 'PERSON' THEN 4 WHEN 'ORGANIZATION' THEN 4 WHEN 'LOCATION' THEN 3 ELSE 1 END DESC, score DESC, entry_no) AS k FROM r) WHERE k = 1""",
    "pseudonyms": f"WITH {_KEYS} SELECT DISTINCT 1 AS scope, k.label, k.key, n.pseudonym FROM keys k JOIN named n ON k.label = n.label AND {_FOLDED % 'k.key'} = n.folded",
    "pseudonym_forms": "WITH d AS (SELECT c_name, " + ", ".join(f"{_DIGEST(k, 'c_name')} AS h_{k.lower()}" for k in ("PHONE", "EMAIL", "IBAN", "SIREN", "SIRET", "DATE", "URL", "OTHER")) + f""" FROM customer)
SELECT c_name, '+33 ' || {_GROUP(f"CASE WHEN {_mod('h_phone', 2)} = 0 THEN '06' ELSE '07' END || {_PAD(_mod('h_phone', 10**8), 8)}", 2)} AS phone,
  substr(regexp_replace({_FOLDED % 'c_name'}, '[^a-z0-9]+', '', 'g'), 1, 14) || '.' || {_PAD(_mod('h_email', 1000), 3)} || '@exemple.fr' AS email,
  'FR' || {_PAD(_mod('h_iban', 97), 2)} || ' ' || {_GROUP(_PAD(_mod('h_iban', 10**23), 23), 4)} AS iban, {_PAD(_mod('h_siren', 10**9), 9)} AS siren, {_PAD(_mod('h_siret', 10**14), 14)} AS siret,
  {_PAD(_DIV('h_date', 13, 28) + ' + 1', 2)} || '/' || {_PAD(_DIV('h_date', 7, 12) + ' + 1', 2)} || '/' || (2018 + {_mod('h_date', 8)}) AS date,
  'https://exemple.fr/res-' || {_PAD(_mod('h_url', 10**6), 6)} AS url, 'ANON-OTHER-' || {_PAD(_mod('h_other', 10**4), 4)} AS other FROM d""",
    "span_tags": f"WITH {_MARKS} SELECT doc_id, s AS start, ord, '<' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY s DESC, ord DESC) || '>' AS tag FROM marks",
    "entity_stats": f"WITH {_MARKS} SELECT doc_id, entity_type AS type, count(*) AS n_mentions, count(DISTINCT ord % 4) AS n_entities FROM marks GROUP BY 1, 2",
    "tag_mapping": f"""WITH {_MARKS}, t AS (SELECT *, '<' || entity_type || '_' || (ord % 4) || '>' AS tag FROM marks),
f AS (SELECT doc_id, tag, entity_type, surface, min(ord) AS o FROM t GROUP BY ALL)
SELECT t.doc_id, t.tag, t.entity_type AS type, arg_min(surface, (-length(surface), ord)) AS canonical, any_value(m) AS mentions, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, 0.5::DOUBLE AS score_avg
FROM t JOIN (SELECT doc_id, tag, string_agg(surface, '|' ORDER BY o) AS m FROM f GROUP BY 1, 2) g ON t.doc_id = g.doc_id AND t.tag = g.tag GROUP BY 1, 2, 3""",
    "merged_mappings": r"""WITH r AS (SELECT entry_no, coalesce(upper(entity_type), 'CAT') AS label, trim(pattern) AS canonical FROM entity_catalog),
s AS (SELECT *, entry_no % 2 AS side, row_number() OVER (PARTITION BY label, entry_no % 2 ORDER BY entry_no) AS n FROM r),
m AS (SELECT label, max(n) AS most FROM s GROUP BY 1),
e AS (SELECT s.*, most, b.n IS NOT NULL AS taken FROM s JOIN m USING (label) LEFT JOIN (SELECT label, n FROM s WHERE side = 0) b ON s.label = b.label AND s.n = b.n WHERE side = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY label, taken ORDER BY n) AS again FROM e)
SELECT 1 AS scope, '<' || label || '_' || n || '>' AS tag, label, canonical, NULL AS old_tag FROM s WHERE side = 0
UNION ALL SELECT 1, '<' || label || '_' || (CASE WHEN taken THEN most + again ELSE n END) || '>', label, canonical, '<' || label || '_' || n || '>' FROM k""",
    "merged_stats": "WITH s AS (SELECT coalesce(upper(entity_type), 'CAT') AS label, count(*) AS n FROM entity_catalog GROUP BY 1) SELECT 1 AS scope, label, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM s",
    "merged_lookups": "SELECT 1 AS scope, lower(trim(pattern)) AS key, arg_min(entry_no, (entry_no % 2, entry_no)) AS value FROM entity_catalog WHERE length(trim(pattern)) > 0 GROUP BY 2",
    "llm_gate": f"""WITH a AS (SELECT rec_id, seg_idx, 'SPEAKER_' || (seg_idx % 2) || ': ' || coalesce(min(text), '') AS told FROM asr_segments GROUP BY 1, 2),
p AS (SELECT rec_id, seg_idx, told AS original, lead(told, 2) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS corrected FROM a)
SELECT rec_id, seg_idx, {_GATE_TAGS('original')} = {_GATE_TAGS('corrected')} AND {_WORDS('corrected')} >= {_WORDS('original')} * 0.5 AND {_WORDS('corrected')} <= {_WORDS('original')} * 1.5 AND NOT ({_OPENING})
  AND NOT regexp_matches(corrected, '(?m)^[0-9]+\\.') AND length(corrected) - length(replace(corrected, '-', '')) <= {_WORDS('original')} * 0.1 AS passes,
  {_LINE_TAGS('original')} = {_LINE_TAGS('corrected')} AND {_GATE_TAGS('original')} = {_GATE_TAGS('corrected')} AS same
FROM p WHERE corrected IS NOT NULL""",
}
