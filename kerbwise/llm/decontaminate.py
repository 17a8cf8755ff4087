"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm import words as W

_U = np.uint64
SHINGLE = 5
BITS = 64
#: Sets at similarity 0.8 lie at a cosine of at least 0.89; their fingerprints differ in 9.7 of 64 bits
#: on average with a standard deviation of 2.9, so 24 is five deviations away.
RADIUS = 24
BLOCK_BITS = 8
#: Items are the caller's benchmark; more words than this are refused rather than sent to every task.
MAX_ITEM_WORDS = 20_000_000


def folded(texts: pa.Array):
    """Hashed words of the lower-cased texts (all alphabets)."""
    return W.words(pc.utf8_lower(texts))


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash from summed signs (ties count as 0)."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(_U).reshape(-1)


class HammingIndex:
    """Fingerprints by eight-bit blocks. Two fingerprints within the radius differ in at most radius // blocks
    bits of some block, so looking up every near value of every block finds all of them."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius = prints, radius
        self.blocks = BITS // BLOCK_BITS

    @functools.cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: how many prints are near each of its values, and those prints, value by value. Made at the first
        search, so that the driver neither holds nor ships the tables of every length of item."""
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= self.radius // self.blocks
        own = self.prints.view(np.uint8).reshape(-1, self.blocks)
        lists = ([np.flatnonzero(near[v][own[:, b]]) for v in range(256)] for b in range(self.blocks))
        return [(np.array([len(x) for x in block]), np.concatenate(block)) for block in lists]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, print, distance) within the radius."""
        parts = queries.view(np.uint8).reshape(-1, self.blocks)
        pairs = []
        for b, (counts, flat) in enumerate(self.tables):
            base = np.cumsum(counts) - counts
            value = parts[:, b].astype(np.int64)
            many = counts[value]
            q = np.repeat(np.arange(len(queries)), many)
            p = flat[np.repeat(base[value], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            pairs.append(q * len(self.prints) + p)
        found = np.unique(np.concatenate(pairs))
        q, p = found // max(1, len(self.prints)), found % max(1, len(self.prints))
        distance = np.bitwise_count(queries[q] ^ self.prints[p])
        keep = distance <= self.radius
        return q[keep], p[keep], distance[keep]


class Items:
    """Benchmark items by their number of words, each length with shingle weights and a Hamming index."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS) -> None:
        self.ids, self.lengths, shingles = ids, {}, {}
        lengths = self.lengths
        for w in folded(pa.array(texts, pa.string())):
            for i in range(len(w)):
                own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                if len(own):
                    lengths[w.first + i] = len(own)
                    shingles[w.first + i] = W.combine(own, min(SHINGLE, len(own)))
        if sum(lengths.values()) > MAX_ITEM_WORDS:
            raise ValueError(f"benchmark of more than {MAX_ITEM_WORDS} words: decontaminate against it in parts")
        self.weights = {i: dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for i, s in shingles.items()}
        by_length = defaultdict(list)
        for i, n in lengths.items():
            by_length[n].append(i)
        self.groups = {}
        for n, members in sorted(by_length.items()):
            prints = fingerprints(np.stack([signs(shingles[i]).sum(0) for i in members]))
            self.groups[n] = (np.array(members), HammingIndex(prints, radius))
        #: Every shingle of an item, with the lengths of the items that hold it.
        self.known = {k: self._known(k) for k in {min(SHINGLE, n) for n in self.groups}}

    def _known(self, k: int) -> tuple[np.ndarray, list[set[int]]]:
        lengths = defaultdict(set)
        for n, (members, _) in self.groups.items():
            if min(SHINGLE, n) == k:
                for i in members:
                    for s in self.weights[i]:
                        lengths[s].add(n)
        keys = np.array(sorted(lengths), _U)
        return keys, [lengths[int(s)] for s in keys]

    def matches(self, own: np.ndarray, threshold: float):
        """(item, first word, similarity, distance): the best window of the words ``own`` for each item found."""
        best: dict[int, tuple] = {}
        for k, (keys, lengths) in self.known.items():
            grams = W.combine(own, k)
            if not len(grams):
                continue
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            anchors = np.flatnonzero(keys[place] == grams)
            if not len(anchors):
                continue
            at = defaultdict(list)
            for a in anchors:
                for n in lengths[place[a]]:
                    at[n].append(a)
            for n, hits in at.items():
                self._windows(grams, np.array(hits), n, k, len(own), threshold, best)
        return [(i, *v) for i, v in best.items()]

    def _windows(self, grams, hits, n, k, total, threshold, best) -> None:
        # windows without any shingle of an item have similarity 0: only those around a hit are fingerprinted
        members, index = self.groups[n]
        n = min(n, total)
        low, high = np.maximum(hits - (n - k), 0), np.minimum(hits, total - n)
        edge = np.zeros(total - n + 2, np.int64)
        np.add.at(edge, low[low <= high], 1)
        np.add.at(edge, high[low <= high] + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[:-1])
        width = n - k + 1
        for chunk in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
            for piece in np.array_split(chunk, -(-len(chunk) // 4096)) if len(chunk) else []:
                first, last = piece[0], piece[-1] + width
                summed = np.zeros((last - first + 1, BITS), np.int32)
                np.cumsum(signs(grams[first:last]), axis=0, out=summed[1:])
                prints = fingerprints(summed[piece - first + width] - summed[piece - first])
                for q, p, distance in zip(*index.search(prints)):
                    item, start = int(members[p]), int(piece[q])
                    similarity = self.similarity(grams[start : start + width], item)
                    if similarity >= threshold and (item not in best or (-similarity, start) < (-best[item][1], best[item][0])):
                        best[item] = (start, similarity, int(distance))

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of shingles: sum of the smaller counts over sum of the larger ones."""
        mine, theirs = defaultdict(int), self.weights[item]
        for s in window.tolist():
            mine[s] += 1
        common = sum(min(c, theirs.get(s, 0)) for s, c in mine.items())
        return common / (len(window) + sum(theirs.values()) - common)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` and item of ``benchmark`` it holds: ``key``, ``item``, start_word, n_words, similarity, distance.

    A document holds an item of n words if one of its windows of n words (all of it, if shorter) has a weighted Jaccard similarity of five-word
    shingles (lower-cased, counted with repeats; shorter items: their whole sequence) of at least ``threshold`` with it.
    Windows come from whole texts; of several windows the most similar, then the first, is reported. Windows that share
    a shingle with an item of their length are fingerprinted, candidates are all items of that length within ``radius``
    bits, and candidates are checked exactly. Null or empty texts and items match nothing, repeated rows are reported each,
    and empty tables give an empty result. Other columns are not read.
    """
    rows = benchmark.select(F.col(item), F.col(item_text)).toArrow()  # the benchmark, refused above MAX_ITEM_WORDS
    items = Items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), radius)
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = rows.column(0).type

    def run(batches):
        for batch in batches:
            keys, found = batch.column(0), []
            for w in folded(batch.column(1)):
                for i in _touched(w, items):
                    own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    for member, start, similarity, distance in items.matches(own, threshold):
                        found.append((w.first + i, items.ids[member], start, items.lengths[member], similarity, distance))
            if found:
                where, ids, start, n, similarity, distance = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(where)), pa.array(ids, item_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(similarity), pa.array(distance, pa.int32())],
                    [key, item, "start_word", "n_words", "similarity", "distance"],
                )

    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, start_word long, n_words long, similarity double, distance int"
    return docs.select(key, text).mapInArrow(W.tidy(run), schema)


def _touched(w: W.Words, items: Items) -> np.ndarray:
    """Texts of the chunk that hold at least one shingle of an item (a shingle across two texts only costs time)."""
    hit = np.zeros(len(w), bool)
    for k, (keys, _) in items.known.items():
        grams = W.combine(w.hashes, k)
        if len(grams):
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            at = np.flatnonzero(keys[place] == grams)
            hit[np.searchsorted(w.bounds, at, "right") - 1] = True
    return np.flatnonzero(hit)
