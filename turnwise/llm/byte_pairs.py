"""Problem 7: the whole corpus in the ids of a public byte-level BPE vocabulary.

Texts are split once by the vocabulary's pattern.  Higher-order functions fold the ranked merges over the byte array of a
distinct word, looking ranks up in a literal map: first for the frequent words, whose ids go to the texts as a literal
map of bounded size, then once for each distinct word that this map lacks, whose ids are joined to the stretches of known
words between which it stands.  No word is folded twice; only texts with such words are shuffled, as ids.  Decoding
concatenates the ids' binary pieces.

The literal maps are arrays with two places for each key, so that a lookup takes the same time however large they are.
A merge changes two ranks only, so long words cost steps, not quadratic lookups.

Bounds: the frequent words are the ``WORDS`` most frequent of about ``SAMPLE`` documents, chosen by hash, of at most
``LETTERS`` letters each; they decide which way a word goes, never its ids.

Defined results: null and empty texts have the ids []; special tokens' strings are ordinary text; each row of the table
gives one row, repeated rows too; texts are read whole, of any length.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.tables import written

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Blank space of any kind, as the vocabulary's pattern means it.
BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The pattern that the vocabulary's merges were made with (fixed value), its most frequent alternative first.
PATTERN = rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
NEVER = (1 << 31) - 1
WORDS, SAMPLE, LETTERS = 30_000, 10_000, 64


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ids, which are their ranks too."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Keeps the literals of the stages that run inside out of explain texts and event logs."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Literal:
    """A map of strings or byte strings as a literal column: a key stands at one of two places that its xxhash64 tells."""

    def __init__(self, entries: dict, kind: str) -> None:
        self.bits = max(4, (5 * len(entries) // 2).bit_length())
        while (placed := self._placed(entries)) is None:
            self.bits += 1
        binary = any(isinstance(k, bytes) for k in entries)
        told = [None if k is None else {"k": base64.b64encode(k).decode() if binary else k, "v": entries[k]} for k in placed]
        self.column = F.from_json(F.lit(json.dumps(told, separators=(",", ":"))), f"array<struct<k:{'binary' if binary else 'string'},v:{kind}>>")

    def places(self, key: str | bytes) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(key if isinstance(key, bytes) else key.encode(), seed=42)
        return h & ((1 << self.bits) - 1), h >> 24 & ((1 << self.bits) - 1)

    def _placed(self, entries: dict) -> list | None:
        """Keys by place; a key that finds its places taken moves one that stands there to its other place."""
        table: list = [None] * (1 << self.bits)
        for key in entries:
            a, b = self.places(key)
            at = a if table[a] is None else b
            for _ in range(200):
                key, table[at] = table[at], key
                if key is None:
                    break
                a, b = self.places(key)
                at = b if at == a else a
            else:
                return None
        return table

    def _entry(self, map_: Column, key: Column, shift: int) -> Column:
        h = F.shiftright(F.xxhash64(key), shift) if shift else F.xxhash64(key)
        return F.get(map_, h.bitwiseAND(F.lit((1 << self.bits) - 1).cast("bigint")).cast("int"))

    def _value(self, map_: Column, key: Column, first: Column) -> Column:
        second = bound(self._entry(map_, key, 24), lambda e: F.when(e["k"] == key, e["v"]))
        return F.when(first["k"] == key, first["v"]).otherwise(second)

    def get(self, map_: Column, key: Column) -> Column:
        """The value of ``key`` in the map as bound to a variable, null if it has none."""
        return bound(self._entry(map_, key, 0), lambda e: self._value(map_, key, e))

    def each(self, map_: Column, keys: Column) -> Column:
        """The values of an array of keys."""
        return F.zip_with(keys, F.transform(keys, lambda k: self._entry(map_, k, 0)), lambda k, e: self._value(map_, k, e))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(word: Column, rank_of) -> Column:
    """The pieces of a byte string after all merges, lowest rank first, leftmost first among equals."""
    n = F.octet_length(word)
    kind = "struct<parts:array<binary>,ranks:array<int>>"
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank_of(F.substring(word, i, F.lit(2))))
    start = F.struct(parts.alias("parts"), pairs.alias("ranks")).cast(kind)
    none = F.array().cast("array<int>")

    def merge_at(acc: Column, j: Column) -> Column:
        p, r = acc["parts"], acc["ranks"]
        one = F.concat(F.element_at(p, j), F.element_at(p, j + 1))

        def put(whole: Column) -> Column:
            left = F.when(j > 1, F.concat(F.slice(r, F.lit(1), j - 2), F.array(rank_of(F.concat(F.element_at(p, j - 1), whole))))).otherwise(none)
            right = F.when(j < F.size(r), F.concat(F.array(rank_of(F.concat(whole, F.element_at(p, j + 2)))), F.slice(r, j + 2, F.greatest(F.size(r) - j - 1, F.lit(0))))).otherwise(none)
            pieces = F.concat(F.slice(p, F.lit(1), j - 1), F.array(whole), F.slice(p, j + 2, F.greatest(F.size(p) - j - 1, F.lit(0))))
            return F.struct(pieces.alias("parts"), F.concat(left, right).alias("ranks")).cast(kind)

        return bound(one, put)

    def step(acc: Column, _: Column) -> Column:
        return bound(F.array_min(acc["ranks"]), lambda low: F.when(low.isNull() | (low == NEVER), acc).otherwise(bound(F.array_position(acc["ranks"], low).cast("int"), lambda j: merge_at(acc, j))))

    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda acc: acc["parts"])
    return F.when(n == 1, F.array(word)).otherwise(folded)


def with_ids(words: DataFrame, rank: Literal) -> DataFrame:
    """word, ids of distinct words: a word's own id if it is in the vocabulary, else those of its merged pieces."""

    def ids_of(x: Column) -> Column:
        of = lambda piece: rank.get(x["map"], piece)
        pieces = lambda: F.transform(merged(x["bytes"], lambda s: F.coalesce(of(s), F.lit(NEVER))), of)
        return bound(of(x["bytes"]), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(pieces()))

    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return spread.select("word", bound(F.struct(rank.column.alias("map"), F.col("word").cast("binary").alias("bytes")), ids_of).alias("ids"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _stretches(words: Column, known: Column) -> Column:
    """Array of (before, word, after): each word without ids, the ids before it, and, for the last one, those after it."""
    at = F.filter(F.sequence(F.lit(1), F.size(known)), lambda i: F.element_at(known, i).isNull())

    def cut(at: Column) -> Column:
        def one(place: Column, k: Column) -> Column:
            begin = F.when(k == 0, F.lit(1)).otherwise(F.get(at, k - 1) + 1)
            rest = F.when(k == F.size(at) - 1, F.slice(known, place + 1, F.size(known) - place)).otherwise(F.array().cast("array<array<int>>"))
            return F.struct(F.flatten(F.slice(known, begin, place - begin)).alias("before"), F.element_at(words, place).alias("word"), F.flatten(rest).alias("after"))

        return F.transform(at, one)

    return bound(at, cut)


def token_ids(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY, words: int = WORDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ids for each row of ``documents``."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with short_plans(spark):
        rank = Literal(ranks(f"{folder}/{vocabulary}"), "int")
        share = min(1.0, sample / max(1, documents.count()))
        some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
        counts = some.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") <= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        often = with_ids(counts.orderBy(F.desc("n"), "word").limit(words).select("word"), rank)
        frequent = Literal({r["word"]: r["ids"] for r in often.collect()}, "array<int>")  # WORDS rows at most
        split = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", bound(F.struct(words_of(F.col("text")).alias("words"), frequent.column.alias("map")), lambda x: F.struct(x["words"].alias("words"), frequent.each(x["map"], x["words"]).alias("known"))).alias("x"))
        # Flattening gives null where a word has no ids.
        known = split.withColumn("ids", F.flatten("x.known"))
        cut = written(known.select("row", "doc_id", "ids", F.when(F.col("ids").isNull(), _stretches(F.col("x.words"), F.col("x.known"))).alias("parts")), "ids")
        parts = cut.where(F.col("ids").isNull()).select("row", "doc_id", F.posexplode("parts").alias("no", "part")).select("row", "doc_id", "no", "part.*")
        rare = written(with_ids(parts.select("word").distinct(), rank).withColumnRenamed("ids", "own"), "rare-words")
    put = F.struct("no", F.concat("before", "own", "after").alias("ids"))
    whole = parts.join(rare, "word").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(put)).alias("all"))
    joined = whole.select("doc_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))
    return cut.where(F.col("ids").isNotNull()).select("doc_id", "ids").unionByName(joined)


def decoded(tokens: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of the ids: their binary pieces, concatenated."""
    table = {i: s.hex() for s, i in ranks(f"{folder}/{vocabulary}").items()}
    pieces = F.from_json(F.lit(json.dumps([table.get(i, "") for i in range(max(table) + 1)])), "array<string>")
    return tokens.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(pieces, i + 1)), "")), "UTF-8").alias("text"))
