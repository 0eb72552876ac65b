"""Passages of held-out evaluation items inside a corpus (problem 7).

The unit that counts as a leak is a passage of ``window`` consecutive words, so items are cut into all
their windows of that size (a window as long as a whole item could not find a partial leak). Every
window of items and documents gets a 64-bit SimHash of its weighted two-word shingles. The fingerprints
of the items are indexed by ``radius + 1`` blocks of bits: two fingerprints within ``radius`` bits agree
in at least one block, so the block lookups miss none. Candidates are verified by the exact weighted
Jaccard similarity of their shingles. A window of which shingles of the items make up less than that
similarity can't be verified whatever its fingerprint, so none is taken of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
RADIUS = 7
SIMILARITY = 0.8
#: Words of evaluation items that one index holds; more items are searched block by block.
BLOCK_WORDS = 2_000_000
#: Positions fingerprinted at a time, which bounds the memory of a task however long a text is.
CHUNK = 60_000
_WORD = re.compile(r"[a-z0-9]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, n_windows long, similarity double, verbatim boolean"


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 after lower-casing and removing accents."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


class _Hasher:
    """64-bit hashes of words; remembers up to a million."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > 1_000_000:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of two-word shingles: position i holds words i and i + 1."""
    x = h[:-1] * _MIX + (h[1:] << np.uint64(31) | h[1:] >> np.uint64(33))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(s: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles of ``s``."""
    out = []
    for at in range(0, max(0, len(s) - size + 1), CHUNK):
        part, w = s[at : at + CHUNK + size - 1], weights[at : at + CHUNK + size - 1].astype(np.int32)
        # One row a bit: running sums then go along contiguous memory.
        bits = np.ascontiguousarray(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).T)
        total = np.zeros((64, len(part) + 1), np.int32)
        np.cumsum(np.where(bits, w, -w), axis=1, out=total[:, 1:])
        packed = np.packbits(total[:, size:] > total[:, :-size], axis=0)
        out.append(np.ascontiguousarray(packed.T).view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints_at(s: np.ndarray, weights: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the runs of ``size`` shingles of ``s`` that begin at ``starts``."""
    out = []
    for at in range(0, len(starts), CHUNK // 12):
        i = starts[at : at + CHUNK // 12, None] + np.arange(size)
        bits = np.unpackbits(np.ascontiguousarray(s[i]).view(np.uint8).reshape(len(i), size, 8), axis=2).astype(np.int32)
        w = weights[i].astype(np.int32)
        total = np.einsum("ms,msb->mb", w, 2 * bits - 1)
        out.append(np.packbits(total > 0, axis=1).view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Index:
    """Windows of the evaluation items by their fingerprints' blocks."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int) -> None:
        self.window, self.radius, self.size = window, radius, window - 1
        self.hash = _Hasher()
        texts = [(i, words_of(t)) for i, t in items if t]
        grams = [(i, w, self.hash(w)) for i, w in texts if len(w) >= window]
        held = Counter(x for _, _, h in grams for x in set(shingles(h).tolist()))
        # A shingle weighs the more the fewer items hold it; those of documents alone weigh most.
        most = 1 + math.log(1 + len(grams))
        self.keys = np.array(sorted(held), dtype=np.uint64)
        self.values = np.array([max(1, round(8 * (most - math.log(held[int(k)])))) for k in self.keys], dtype=np.int32)
        self.rare = max(1, round(8 * most))
        prints, self.item, self.words, self.grams = [], [], [], []
        for i, w, h in grams:
            s = shingles(h)
            prints.append(fingerprints(s, self.weigh(s), self.size))
            for at in range(len(w) - window + 1):
                self.item.append(i)
                self.words.append(h[at : at + window])
                self.grams.append(s[at : at + self.size])
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.item = np.array(self.item, dtype=np.int64)
        self.words = np.array(self.words, dtype=np.uint64).reshape(-1, window)
        self.grams = np.array(self.grams, dtype=np.uint64).reshape(-1, self.size)
        edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            value = self.block(self.prints, lo, hi)
            order = np.argsort(value, kind="stable")
            keys, start = np.unique(value[order], return_index=True)
            self.blocks.append((lo, hi, order, keys, np.append(start, len(order))))

    @staticmethod
    def block(p: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (p >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def weigh(self, s: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(s), self.rare, np.int32)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.values[at], self.rare)

    def known(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return self.keys[at] == s

    def near(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in ``p``, window of an item) whose fingerprints differ in at most ``radius`` bits."""
        left, right = [], []
        for lo, hi, order, keys, start in self.blocks:
            if not len(keys):
                continue
            value = self.block(p, lo, hi)
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == value)
            n = start[at[hit] + 1] - start[at[hit]]
            a = np.repeat(hit, n)
            b = order[np.repeat(start[at[hit]] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())]
            close = np.bitwise_count(p[a] ^ self.prints[b]) <= self.radius
            left.append(a[close])
            right.append(b[close])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard of two bags of shingles."""
        x, y = Counter(a.tolist()), Counter(b.tolist())
        keys = np.array(list(x | y), dtype=np.uint64)
        w = dict(zip(keys.tolist(), self.weigh(keys).tolist()))
        return sum(w[k] * n for k, n in (x & y).items()) / max(1, sum(w[k] * n for k, n in (x | y).items()))

    def leaks(self, texts: list[list[str]], similarity: float) -> list[tuple[int, int, int, float, bool]]:
        """For texts as words: (text's number, item, its windows that match, best similarity, whether one matches word for word)."""
        sizes = [len(w) for w in texts]
        if max(sizes, default=0) < self.window or not len(self.prints):
            return []
        h = np.concatenate([self.hash(w) for w in texts if w])
        owner = np.repeat(np.arange(len(texts)), sizes)
        s = shingles(h)
        w, known = self.weigh(s), self.known(s)
        sums = np.zeros((2, len(s) + 1), np.int64)
        np.cumsum(w, out=sums[0, 1:])
        np.cumsum(np.where(known, w, 0), out=sums[1, 1:])
        whole, held = sums[:, self.size :] - sums[:, : -self.size]
        n = len(s) - self.size + 1
        within = owner[:n] == owner[self.size : self.size + n]  # windows of one text
        starts = np.flatnonzero(within & (held >= similarity * whole))
        left, right = self.near(fingerprints_at(s, w, self.size, starts))
        left = starts[left]
        same = (h[left[:, None] + np.arange(self.window)] == self.words[right]).all(axis=1) if len(left) else np.zeros(0, bool)
        positions: dict[tuple[int, int], set[int]] = defaultdict(set)
        best: dict[tuple[int, int], float] = {}
        verbatim: set[tuple[int, int]] = set()
        for a, b, equal in zip(left.tolist(), right.tolist(), same.tolist()):
            like = 1.0 if equal else self.similarity(s[a : a + self.size], self.grams[b])
            if like >= similarity:
                k = int(owner[a]), int(self.item[b])
                positions[k].add(a)
                best[k] = max(best.get(k, 0.0), like)
                if equal:
                    verbatim.add(k)
        return [(*k, len(at), best[k], k in verbatim) for k, at in positions.items()]


def _portions(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Documents as words, in portions of about ``most`` words or one document."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for d, t in zip(batch["d"].tolist(), batch["t"]):
            words = words_of(t)
            ids.append(d)
            texts.append(words)
            n += len(words)
            if n >= most:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage",
    window: int = WINDOW, radius: int = RADIUS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents that hold passages of ``items``: doc_id, item_id, n_windows, similarity, verbatim.

    A row per document row and item of which a window of ``window`` words lies within ``radius`` bits and
    at or above ``similarity``; ``verbatim`` tells that a window agrees word for word. Documents are
    scanned whole, in one pass without a shuffle, for each block of items; blocks are so many that each
    holds about ``block_words`` words, so what a task keeps does not grow with the items.

    Null ids, null or empty texts, texts and items under ``window`` words, empty tables: no rows. Repeated rows of
    a document each give their rows. Items with one id count as one item.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("i IS NOT NULL AND p IS NOT NULL")
    n_words = held.agg(F.coalesce(F.sum(F.size(F.split("p", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(n_words / block_words))
    held = held.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n_blocks)))
    base = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND d IS NOT NULL")
    found = None
    for k in range(n_blocks):
        # Built once; its size follows from ``block_words``, whatever the number of items.
        index = spark.sparkContext.broadcast(Index([(r["i"], r["p"]) for r in held.where(F.col("block") == k).toLocalIterator()], window, radius))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ready = index.value
            for ids, texts in _portions(batches, 2 * CHUNK):
                rows = [(ids[k], *rest) for k, *rest in ready.leaks(texts, similarity)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_windows", "similarity", "verbatim"])

        part = base.mapInPandas(search, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found
