"""Problem 8: evaluation texts that leaked into training texts.

Latent semantic retrieval: documents are cut into overlapping passages of words, the passages' TF-IDF matrix over the
words of the items gets a distributed randomised SVD (sketches of its Gram matrix are summed over all partitions), and
each passage's latent vector is compared with those of the items' windows by cosine.  Candidates are then checked by the
longest chain of common successive words, which tolerates a single changed, missing, repeated or broken word between
blocks of three or more equal words; what has no such chain is a paraphrase if most of the item's words follow in order
(longest common subsequence) and the item's answer comes with them.

Words are compared without case, accents, punctuation, invisible and look-alike characters, markup and bracketed
numbers.  Statistics and search cover every word of every document.  The items are few and fixed (held-out tests);
they are taken in blocks of ``ITEM_BLOCK`` so that what the tasks are sent has a bound whatever their number.

Defined results: items that are null, empty or shorter than ``LEAST`` words leak nowhere; null and empty documents hold
nothing; one row for each (item, document), however often the passage occurs; repeated documents (equal doc_id) give
one row; further columns are ignored; an empty table on either side gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.abuse import folded
from turnwise.sources.tables import written

LEAST = 12
#: Words of a passage, and from one passage to the next: any LEAST words with a few edits lie within one passage.
PASSAGE, STRIDE = 32, 16
RANK, EXTRA = 64, 8
ITEM_BLOCK = 2_000
#: Distinct words of a block of items, less than this; a block with more is halved.
MOST = 1 << 21
#: Words in more than this share of the passages carry no weight; items of such words alone are searched word by word.
COMMON = 0.05
#: The least cosine of a candidate passage with an item's window.
COSINE = 0.45
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[\[({]\s*\d+\s*[\])}]")
_MARKUP = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]{1,6});")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑­]\s*\n\s*(?=[^\W\d_])")
_UNSEEN_SIGNS = "\u00ad\u034f\u061c\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0f\ufeff"
_UNSEEN = re.compile("[­͏​-‏‪-‮⁠-⁯︀-️﻿]")


def _plain(text: str) -> str:
    """``text`` without broken lines, markup, invisible characters and numbers in brackets that hold blanks."""
    if "-\n" in text or "\u2010\n" in text or "\u2011\n" in text or "\u00ad\n" in text or "- \n" in text:
        text = _BREAK.sub("", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "( " in text or "[ " in text or " )" in text or " ]" in text or "{" in text:
        text = _NUMBER.sub(" ", text)
    if not text.isascii():
        if any(c in text for c in _UNSEEN_SIGNS):
            text = _UNSEEN.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return text.lower()


def _split(token: str) -> list[str]:
    """The words of what stands between two blanks."""
    return _WORD.findall(_NUMBER.sub(" ", token))


def words(text: str) -> list[str]:
    """Lower-case words, without what makes no difference; accents and look-alikes are folded word by word."""
    return [w for token in _plain(text).split() for w in _split(token)]


class Encoder:
    """Words as numbers: those of the items from 1, all others 0.  What stands between blanks is looked up at once."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        # Below 0: no word (-1), or several words, by their place in ``several``.
        self.seen: dict[str, int] = {}
        self.several: list[list[int]] = [[], []]

    def number(self, word: str) -> int:
        found = self.vocabulary.get(word, 0)
        return found or (0 if word.isascii() else self.vocabulary.get(folded(word), 0))

    def learn(self, tokens: set[str]) -> None:
        for token in tokens:
            numbers = [self.number(w) for w in _split(token)]
            if len(numbers) == 1:
                self.seen[token] = numbers[0]
            elif numbers:
                self.seen[token] = -len(self.several)
                self.several.append(numbers)
            else:
                self.seen[token] = -1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words, and where each text's begin, with the end."""
        tokens = [_plain(t).split() if t else [] for t in texts]
        first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        if len(self.seen) > 2_000_000:
            self.forget()
        self.learn(set(chain.from_iterable(tokens)).difference(self.seen))
        ids = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(tokens)), np.int64, int(first[-1]))
        counts = (ids >= 0).astype(np.int64)
        many = np.flatnonzero(ids < -1)
        sizes = np.array([len(x) for x in self.several])
        counts[many] = sizes[-ids[many]]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.repeat(ids, counts)
        values = np.array(list(chain.from_iterable(self.several)), np.int64)
        size, begin = counts[many], (np.cumsum(sizes) - sizes)[-ids[many]]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(ends[many], size) + step] = values[np.repeat(begin, size) + step]
        return flat.astype(np.int32), ends[first]


def passages(ids: list[np.ndarray], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several documents: (passage, word) pairs with their counts, and each passage's document and start."""
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int32)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(ids)), lengths)
    at = np.flatnonzero(flat)
    place = at - first[doc[at]]
    per_doc = np.maximum(1, -(-(lengths - PASSAGE) // stride) + 1)
    base = np.concatenate([[0], np.cumsum(per_doc)])
    pairs = []
    for back in range(PASSAGE // stride):
        index = place // stride - back
        ok = (index >= 0) & (index < per_doc[doc[at]])
        pairs.append((base[:-1][doc[at[ok]]] + index[ok]) * (1 << 32) + flat[at[ok]])
    key, count = np.unique(np.concatenate(pairs), return_counts=True)
    owner = np.repeat(np.arange(len(ids)), per_doc)
    start = (np.arange(base[-1]) - base[:-1][owner]) * stride
    return key >> 32, key & ((1 << 32) - 1), count, np.stack([owner, start])


def latent(passage: np.ndarray, word: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of the passages that hold a weighted word, and these passages' numbers."""
    at = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.empty(0, np.int64)
    if not len(at):
        return np.empty((0, basis.shape[1]), np.float32), at
    return np.add.reduceat(weight[:, None] * basis[word], at, axis=0), passage[at]


def _chunks(batches: Iterator[pa.RecordBatch], docs: int = 400) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, docs):
            part = batch.slice(k, docs)
            lists = part.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            yield part, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def encoded(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id and the numbers of its words, in order, written to the shared folder: later passes read no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                flat, offsets = encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    slim = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return written(slim.mapInArrow(run, "doc_id bigint, ids array<int>"), "words")


def idf_of(docs: DataFrame, size: int) -> np.ndarray:
    """Inverse passage frequencies of the items' words over all passages; 0 for common words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, ids in _chunks(batches):
            _, word, _, owner = passages(ids, PASSAGE)
            total += np.bincount(word, minlength=size)
            total[0] += owner.shape[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    found = docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word of the items
    n = np.ones(size)
    for r in found:
        n[r["word"]] = r["n"]
    idf = np.log(max(1.0, n[0]) / n)
    idf[n > COMMON * n[0]] = 0.0
    idf[0] = 0.0
    return idf.astype(np.float32)


def gram_times(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The TF-IDF matrix's Gram matrix times ``basis``, summed over all passages."""
    size, wide = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, wide))
        for _, ids in _chunks(batches):
            passage, word, count, _ = passages(ids, PASSAGE)
            weight = count * idf[word]
            some = weight > 0
            passage, word, weight = passage[some], word[some], weight[some].astype(np.float32)
            vectors, numbers = latent(passage, word, weight, basis)
            if not len(numbers):
                continue
            # Rows of one word stand together, so that each word's sum is one reduction.
            rows = weight[:, None] * vectors[np.searchsorted(numbers, passage)]
            order = np.argsort(word, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0]))
            total[word[order][at]] += np.add.reduceat(rows[order], at, axis=0)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, j]) for j in range(wide)]], ["word", *[f"y{j}" for j in range(wide)]])

    schema = "word bigint, " + ", ".join(f"y{j} double" for j in range(wide))
    sums = docs.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(wide)]).collect()  # one row a word of the items
    out = np.zeros((size, wide))
    for r in sums:
        out[r["word"]] = r[1:]
    return out


def latent_basis(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, by a randomised SVD with one power iteration."""
    wide = min(RANK + EXTRA, len(idf))
    start = np.random.default_rng(8).standard_normal((len(idf), wide)).astype(np.float32)
    q, _ = np.linalg.qr(gram_times(docs, idf, start))
    small = q.T @ gram_times(docs, idf, q.astype(np.float32))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


class Items:
    """The items of one block: their words' numbers, windows' latent vectors and the places of their word triples."""

    def __init__(self, rows: list[tuple[int, str, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        self.answers: list[list[int]] = []
        for item, text, answer in rows:
            found = [folded(w) for w in words(text)]
            if len(found) < LEAST:
                continue
            self.ids.append(item)
            self.texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
            self.answers.append([self.vocabulary.setdefault(folded(w), len(self.vocabulary) + 1) for w in words(answer or "")])
        size = len(self.vocabulary) + 1
        triples = []
        for i, t in enumerate(self.texts):
            key = (t[:-2] * size + t[1:-1]) * size + t[2:]
            triples.append(np.stack([key, np.full(len(key), i), np.arange(len(key))]))
        joined = np.concatenate(triples, axis=1) if triples else np.empty((3, 0), np.int64)
        self.triples = joined[:, np.argsort(joined[0], kind="stable")]
        self.size = size

    def windows(self, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalized latent vectors of the windows, their items, and the fewest distinct weighted words of any LEAST words
        of each; ordered by these.  Windows overlap so that any LEAST successive words lie within one."""
        vectors, owner, fewest = [], [], []
        for i, t in enumerate(self.texts):
            weighted = idf[t] > 0
            distinct = [len(set(t[k : k + LEAST][weighted[k : k + LEAST]].tolist())) for k in range(len(t) - LEAST + 1)]
            for k in range(0, max(1, len(t) - LEAST + 1), LEAST):
                part = t[k : k + 2 * LEAST]
                vectors.append((idf[part][:, None] * basis[part]).sum(axis=0))
                owner.append(i)
                fewest.append(min(distinct[k : k + LEAST + 1]))
        v = np.array(vectors, np.float32)
        order = np.argsort(fewest, kind="stable")
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))[order], np.array(owner)[order], np.array(fewest)[order]


def blocks_of(hits: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in item, place in document, words) of the longest equal stretches, from the places of equal triples."""
    diagonal = hits[0] - hits[1]
    order = np.lexsort((hits[1], diagonal))
    p, q, d = hits[0][order], hits[1][order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (q[1:] != q[:-1] + 1)]))
    length = np.diff(np.concatenate([new, [len(p)]])) + 2
    return sorted(zip(q[new].tolist(), p[new].tolist(), length.tolist()))


#: One edit to so many words at most.
EVERY = 8
#: (words skipped in the item, in the document) between two blocks: changed, missing, repeated or put in, broken in two, run together.
EDITS = frozenset([(1, 1), (1, 0), (0, 1), (1, 2), (2, 1)])


def longest_chain(hits: np.ndarray) -> tuple[int, int, int]:
    """The most successive item words found in a chain of blocks with edits now and then, and the chain's place.

    Between two blocks stands one edit, and a chain of n words has n / EVERY edits at most: sentences of one pattern with
    other nouns share short blocks, but change too often.  A chain's blocks are a common subsequence of item and document.
    """
    best = (0, 0, 0)
    ends: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # by end in document: end in item, chains: (edits, item start, document start)
    for q, p, n in blocks_of(hits):
        chains = [(0, p, q)]
        for qe in range(q - 2, q + n):
            for pe, before in ends.get(qe, ()):
                over = max(0, qe - q, pe - p)
                if over < n and (p + over - pe, q + over - qe) in EDITS:
                    chains += [(edits + 1, s, f) for edits, s, f in before]
        chains.sort()
        kept: list[tuple[int, int, int]] = []
        for edits, s, f in chains:
            if (not kept or s < kept[-1][1]) and edits <= (p + n - s) // EVERY + 2:
                kept.append((edits, s, f))
                if p + n - s > best[0] and edits <= (p + n - s) // EVERY:
                    best = (p + n - s, f, q + n)
        ends.setdefault(q + n, []).append((p + n, kept))
    return best


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, by bit rows (one step a word of ``b``)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for x in b:
        if (m := at.get(x, 0)) and x:
            row = (row + (row & m) | row & ~m) & (1 << len(a)) - 1
    return len(a) - row.bit_count()


def holds(words_: np.ndarray, answer: list[int]) -> bool:
    """Whether the words of ``answer`` stand together in ``words_``."""
    n = len(answer)
    if not n or len(words_) < n:
        return False
    same = words_[: len(words_) - n + 1] == answer[0]
    for k in range(1, n):
        same = same & (words_[k : len(words_) - n + 1 + k] == answer[k])
    return bool(same.any())


#: A paraphrase: the cosine of its passage, at least, and the share of the item's words that follow in order, at least.
PARAPHRASE, FOLLOWED = 0.8, 0.6


def leak_finder(items: Items, idf: np.ndarray, basis: np.ndarray):
    """The search over encoded documents: doc_id, item_id, kind, n_words, cosine, answer_near.

    ``copy``: a chain of LEAST words or more.  ``paraphrase``: no such chain, but a passage of high cosine holds most of the
    item's words in their order, and the item's answer stands in it or behind it.
    """
    vectors, owner, fewest = items.windows(idf, basis)
    keys, (item_of, place_of) = items.triples[0], items.triples[1:]
    n_items = len(items.ids)
    # Items of which LEAST words may carry hardly any weight have no latent vector to be found by: their triples decide.
    plain = np.zeros(n_items, bool)
    plain[owner[fewest <= 2]] = True

    def near_pairs(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item) of passages and windows with a close cosine, as sorted numbers, with the best cosine and its place."""
        passage, word, count, where = passages(ids, STRIDE)
        weight = count * idf[word]
        some = weight > 0
        passage, word, weight = passage[some], word[some], weight[some].astype(np.float32)
        z, numbers = latent(passage, word, weight, basis)
        found = [(np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64))]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        # LEAST words with an edit or two hold all but two of a window's words: passages that hold fewer weighted
        # words than that are not compared with the window.
        held = np.bincount(passage, minlength=where.shape[1])[numbers] if len(numbers) else numbers
        for h in np.unique(held):
            some = np.flatnonzero(held == h)
            upto = int(np.searchsorted(fewest, h + 2, "right"))
            for k in range(0, len(some), 1024) if upto else ():
                rows = some[k : k + 1024]
                near = z[rows] @ vectors[:upto].T
                close = np.flatnonzero(near.max(axis=1) >= COSINE)
                near = near[close]
                a, b = np.nonzero(near >= COSINE)
                doc, start = where[:, numbers[rows[close[a]]]]
                found.append((doc * n_items + owner[b], near[a, b], start))
        pair, value, start = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-value, pair))
        first = order[np.concatenate([[True], np.diff(pair[order]) != 0])] if len(order) else order
        return pair[first], value[first], start[first]

    def common_triples(ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(document, item) as a number and the places of their equal triples (in item, in document), where there are enough."""
        lengths = np.array([len(x) for x in ids], np.int64)
        first = np.cumsum(lengths) - lengths
        flat, doc = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(len(ids)), lengths)
        if len(flat) < 3:
            return
        at = np.flatnonzero((flat[:-2] > 0) & (flat[1:-1] > 0) & (flat[2:] > 0) & (doc[:-2] == doc[2:]))
        key = (flat[at] * items.size + flat[at + 1]) * items.size + flat[at + 2]
        low = np.searchsorted(keys, key, "left")
        met = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == key)
        at, key, low = at[met], key[met], low[met]
        many = np.searchsorted(keys, key, "right") - low
        each = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        pair = doc[at] * n_items + item_of[each]
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0])) if len(order) else order
        for a, b in zip(starts, [*starts[1:], len(order)]):
            # LEAST words with one edit hold six equal triples at least.
            if b - a >= LEAST // 2:
                rows = order[a:b]
                yield int(pair[rows[0]]), np.stack([place_of[each[rows]], at[rows] - first[doc[at[rows]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _chunks(batches):
            pair, cosine, start = near_pairs(ids)
            rows, copied = [], set()
            for number, hits in common_triples(ids):
                doc, item = divmod(number, n_items)
                k = int(np.searchsorted(pair, number))
                known = k < len(pair) and pair[k] == number
                if not known and not plain[item]:
                    continue
                n, _, end = longest_chain(hits)
                if n >= LEAST:
                    copied.add(number)
                    rows.append((part.column(0)[doc].as_py(), items.ids[item], "copy", n, float(cosine[k]) if known else 0.0, holds(ids[doc][end:], items.answers[item])))
            for k in np.flatnonzero(cosine >= PARAPHRASE):
                doc, item = divmod(int(pair[k]), n_items)
                if int(pair[k]) not in copied and items.answers[item]:
                    own, t = items.texts[item].tolist(), ids[doc]
                    begin = max(0, int(start[k]) - len(own))
                    if holds(t[begin:], items.answers[item]):
                        n = common_subsequence(own, t[begin : int(start[k]) + PASSAGE + len(own)].tolist())
                        if n >= max(LEAST, FOLLOWED * len(own)):
                            rows.append((part.column(0)[doc].as_py(), items.ids[item], "paraphrase", n, float(cosine[k]), True))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "kind", "n_words", "cosine", "answer_near"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, n_words (of the longest chain or subsequence), cosine (rounded), answer_near for each leak.

    A document that both copies and paraphrases an item (in rows of equal doc_id) counts as a copy.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, kind string, n_words bigint, cosine double, answer_near boolean"
    found = spark.createDataFrame([], schema)
    blocks: list[list[tuple]] = []
    rows = iter(items.select("item_id", "text", "answer").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator())
    while block := blocks.pop() if blocks else [tuple(r) for r in islice(rows, ITEM_BLOCK)]:
        of = Items(block)
        if of.size >= MOST and len(block) > 1:  # three word numbers must fit one key
            blocks += [block[: len(block) // 2], block[len(block) // 2 :]]
            continue
        if of.size >= MOST:
            raise ValueError(f"item {block[0][0]} has {of.size} distinct words; {MOST} are too many")
        if not of.ids:
            continue
        docs = encoded(documents, of.vocabulary)
        idf = idf_of(docs, of.size)
        found = found.unionByName(docs.mapInArrow(leak_finder(of, idf, latent_basis(docs, idf)), schema))
    best = found.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"), F.max(F.struct(F.col("kind") == "copy", "n_words"))["n_words"].alias("n_words"), F.max("cosine").alias("cosine"), F.max("answer_near").alias("answer_near"))
    return best.withColumn("cosine", F.round("cosine", 3))
