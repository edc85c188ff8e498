"""Evaluation texts that leaked into training text.

Items and documents are cut into sliding windows of ``WINDOW`` words. A window's SimHash sums the signs of its
shingles' hashes, each by its weight: a shingle that many items share weighs less. The items' fingerprints are kept in
four tables, one per 16-bit block: two fingerprints within a Hamming distance of 3 agree in at least one block, so the
tables lose no fingerprint inside the radius. Candidates are verified by the weighted similarity of their shingles;
of those that pass, the windows with the same words in the same order are counted apart from the similar ones.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SHINGLE, RADIUS, BLOCKS, SIMILARITY = 12, 5, 3, 4, 0.8
#: Most windows of items that are sent to the tasks at once; more items are searched in parts.
MAX_ITEM_WINDOWS = 2_000_000
#: Weight of a shingle that one item holds alone, or none; it falls by one with each doubling of the items that hold it.
RAREST = 8

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; all else, underscores included, only separates them."""
    return _WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """64-bit hashes of words, remembered while a task runs."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _MIX + words[k : k + n]
    return _mixed(total)


def fingerprints(shingles: np.ndarray, weights: np.ndarray, per_window: int) -> np.ndarray:
    """SimHash of every run of ``per_window`` neighbouring shingles (uint64 each)."""
    n = len(shingles) - per_window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    signed = np.where(bits, weights[:, None], -weights[:, None]).astype(np.int32)
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(signed, axis=0, out=sums[1:])
    over = (sums[per_window:] - sums[:-per_window]) > 0
    return np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)


class ItemIndex:
    """Windows of all items, their fingerprints, and one table per block of bits."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, radius: int = RADIUS):
        self.window, self.radius, self.per_window = window, radius, window - SHINGLE + 1
        hashes = _Hashes()
        cut = [(item, h, shingle_hashes(h)) for item, h in ((i, hashes.of(words_of(t))) for i, t in items)]
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.shared, held = np.unique(cat([np.unique(s) for _, _, s in cut], np.uint64), return_counts=True)
        self.weight = np.maximum(RAREST - np.floor(np.log2(np.maximum(held, 1))), 1).astype(np.int32)
        ids, words, prints, starts = [], [], [], []
        base = 0
        for item, h, s in cut:
            p = fingerprints(s, self.weights(s), self.per_window)
            ids.append(np.full(len(p), item, np.int64))
            starts.append(base + np.arange(len(p)))
            words.append(h)
            prints.append(p)
            base += len(h)
        self.item, self.start, self.words, self.prints = cat(ids, np.int64), cat(starts, np.int64), cat(words, np.uint64), cat(prints, np.uint64)
        self.blocks = []
        for b in range(BLOCKS):
            key = self.block(self.prints, b)
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange(65537))
            self.blocks.append((order, first))

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Weight of every shingle by the number of items that hold it."""
        if not len(self.shared):
            return np.full(len(shingles), RAREST, np.int32)
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[at] == shingles, self.weight[at], np.int32(RAREST))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the index) of all pairs of fingerprints within the radius."""
        at, hit = [], []
        for b, (order, first) in enumerate(self.blocks):
            key = self.block(prints, b)
            lo, n = first[key], first[key + 1] - first[key]
            place = np.repeat(np.arange(len(prints)), n)
            offset = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            other = order[np.repeat(lo, n) + offset]
            near = np.bitwise_count(prints[place] ^ self.prints[other]) <= self.radius
            at.append(place[near])
            hit.append(other[near])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(hit)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def similarity(self, words: np.ndarray, starts: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the shingles of candidate windows, repeated shingles by their number."""
        span = np.arange(self.window)
        sides = []
        for w in (words[starts[:, None] + span], self.words[self.start[hits][:, None] + span]):
            total = np.zeros((len(w), self.per_window), np.uint64)
            for k in range(SHINGLE):
                total = total * _MIX + w[:, k : k + self.per_window]
            s = np.sort(_mixed(total), axis=1)
            again = np.zeros(s.shape, np.uint64)  # the how-manieth of its kind in its window
            for k in range(1, self.per_window):
                again[:, k] = np.where(s[:, k] == s[:, k - 1], again[:, k - 1] + np.uint64(1), np.uint64(0))
            sides.append((s + again * _MIX, self.weights(s.ravel()).reshape(s.shape)))
        (a, wa), (b, wb) = sides
        both = (wa * (a[:, :, None] == b[:, None, :]).any(axis=2)).sum(axis=1)
        return both / np.maximum(wa.sum(axis=1) + wb.sum(axis=1) - both, 1)

    def same(self, words: np.ndarray, starts: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Whether candidate windows hold the same words in the same order."""
        span = np.arange(self.window)
        return (words[starts[:, None] + span] == self.words[self.start[hits][:, None] + span]).all(axis=1)


def _in_parts(items: DataFrame, item_key: str, text: str, window: int, most: int) -> list[list[tuple[int, str]]]:
    """The items with a window at all, in parts of about ``most`` windows at most; their number is counted before any is fetched."""
    n = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) - (window - 1)
    long = items.select(F.col(item_key).alias("item"), F.col(text).alias("text"), n.alias("n")).where("item is not null and text is not null and n > 0")
    total = long.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // most)
    out = []
    for k in range(parts):
        own = long.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else long
        out.append([(r[0], r[1]) for r in own.select("item", "text").toLocalIterator()])
    return out


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, key: str = "doc_id", item_key: str = "item_id", text: str = "text", most: int = MAX_ITEM_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows, near) of documents that share windows of ``window`` words with items.

    ``windows`` counts pairs of windows with the same words in the same order, ``near`` those within the radius whose
    shingles have at least that weighted similarity without being the same. Null, empty and shorter texts share nothing;
    a document or item id given several times is one. Items of more than ``most`` windows are searched in parts, each
    sent to every task, so that no task or broadcast grows with the items.
    """
    kind = documents.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, `{item_key}` bigint, windows bigint, near bigint"
    told = documents.select(key, text).where(F.col(key).isNotNull())
    found = None
    for part in _in_parts(items, item_key, text, window, most):
        one = told.mapInPandas(_searcher(documents.sparkSession.sparkContext.broadcast(ItemIndex(part, window)), similarity, key, item_key, text), shape)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return documents.sparkSession.createDataFrame([], shape)
    return found.groupBy(key, item_key).agg(F.max("windows").alias("windows"), F.max("near").alias("near"))


def _searcher(index, similarity: float, key: str, item_key: str, text: str):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hashes = index.value, _Hashes()
        for frame in frames:
            frame = frame[frame[text].notna()]
            docs, n_words = [], []
            flat: list[str] = []
            for t in frame[text]:
                w = words_of(t)
                flat += w
                n_words.append(len(w))
            words = hashes.of(flat)
            length = np.array(n_words, np.int64)
            end = np.cumsum(length)
            for a in range(0, len(frame), 512):  # some documents at a time, for their bits need 256 bytes a word
                b = min(a + 512, len(frame))
                lo, hi = (end[a] - length[a], end[b - 1]) if b > a else (0, 0)
                part = words[lo:hi]
                s = shingle_hashes(part)
                for c in range(0, max(1, len(s) - own.per_window + 1), 200_000):
                    piece = s[c : c + 200_000 + own.per_window - 1]
                    p = fingerprints(piece, own.weights(piece), own.per_window)
                    place, hit = own.candidates(p)
                    if not len(place):
                        continue
                    start = place + c
                    doc = np.searchsorted(end[a:b] - lo, start, side="right")
                    inside = start + own.window <= (end[a:b] - lo)[doc]
                    start, hit, doc = start[inside], hit[inside], doc[inside]
                    good = own.similarity(part, start, hit) >= similarity
                    start, hit, doc = start[good], hit[good], doc[good]
                    exact = own.same(part, start, hit)
                    docs.append(pd.DataFrame({key: frame[key].to_numpy()[a + doc], item_key: own.item[hit], "windows": exact.astype(np.int64), "near": (~exact).astype(np.int64)}))
            if docs:
                yield pd.concat(docs).groupby([key, item_key], as_index=False)[["windows", "near"]].sum()

    return search
