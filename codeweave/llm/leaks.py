"""Benchmark items in documents, by SimHash of item-sized windows.

For every length that an item has, all windows of that many words are looked at. Windows that can't be similar to any
item are passed over by a bound: a similarity of 0.8 in 5-word shingles needs 0.8 of the item's shingles in the window,
so at least that many and three more of its neighbouring word pairs are pairs of some item. The others are
fingerprinted (64 bits; every word votes with its hash; prefix sums give all windows of a text). A multi-index finds all
items of that length within RADIUS: fingerprints are cut into four blocks of 16 bits, so two within 15 differ in at most
3 bits of some block, and an index per block holds every item under all keys within 3 bits. Candidates are verified:
the weighted Jaccard similarity (sum of smaller over sum of larger counts) of the two's 5-word shingles.

A document that is shorter than an item but has 0.8 of its shingles' number at least is one window, the whole document.

Items are collected in slices of about SLICE items and SLICE_BYTES, each a pass over the documents, so what goes to the
executors is bounded (by the longest item beyond that).
Documents aren't shuffled.

Defined results: null texts are empty and hold nothing; an item of 1 to 4 words is one shingle, so it is found where its
words stand in a document in a row; items without words are not looked for; of a document's windows for an item the most similar counts, the first of equals; equal items are all reported;
rows with equal ids are searched one by one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.textcols import GOLD, mix, runs, shingles, words

SIZE, THRESHOLD = 5, 0.8
RADIUS = 15
BLOCKS = 4
#: Items and bytes of their texts in a pass: an index has 697 keys of two bytes for an item and block, so 45 MB.
SLICE, SLICE_BYTES = 8_000, 16 << 20
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"

#: All ways to change at most 3 of 16 bits.
NEAR = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), k)], np.uint16)


def pairs_of(h: np.ndarray) -> np.ndarray:
    """A hash of every word with the next."""
    return mix(h[:-1] * GOLD + mix(h[1:])) if len(h) > 1 else np.zeros(0, np.uint64)


def votes(h: np.ndarray) -> np.ndarray:
    """(words + 1, 64) sums of the votes of the words before."""
    bits = np.unpackbits(mix(h + np.uint64(7)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def fingerprints(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """(windows, 4) uint16 blocks; a tied bit is 0."""
    return np.packbits(sums[start + size] > sums[start], axis=1).view(np.uint16).reshape(-1, BLOCKS)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = np.minimum(nx[i], ny[j]).sum()
    return float(low / (len(a) + len(b) - low))


class Items:
    """The items of one length, with a table for each block from a key to the items that have it within 3 bits."""

    def __init__(self, ids: np.ndarray, texts: list[np.ndarray]):
        self.ids, self.size = ids, len(texts[0])
        self.shingles = [shingles(h, np.array([0, len(h)]), SIZE)[0] for h in texts]
        self.prints = np.concatenate([fingerprints(votes(h), np.zeros(1, np.int64), self.size) for h in texts])
        self.need = int(np.ceil(THRESHOLD * (self.size - SIZE + 1))) + SIZE - 2
        self.tables = []
        for b in range(BLOCKS):
            keys = (self.prints[:, b, None] ^ NEAR[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))])
            self.tables.append((at, (order // len(NEAR)).astype(np.uint16)))  # a slice has fewer items than 2**16

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within RADIUS."""
        n, found = len(self.ids), []
        for b, (at, item) in enumerate(self.tables):
            key = prints[:, b].astype(np.int64)
            count = at[key + 1] - at[key]
            w = np.repeat(np.arange(len(key)), count)
            place = np.repeat(at[key] - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(w * n + item[place].astype(np.int64))
        pair = np.unique(np.concatenate(found))
        w, item = pair // n, pair % n
        apart = np.bitwise_count(prints[w] ^ self.prints[item]).sum(axis=1)
        return w[apart <= RADIUS], item[apart <= RADIUS]


class Index:
    def __init__(self, ids: list[int], texts: list[str]):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        known = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, j, data, offsets in runs(pa.array(texts, pa.string())):
            h, _, first = words(data, offsets)
            for k in range(j - i):
                own = h[first[k] : first[k + 1]]
                if 0 < len(own) < SIZE:
                    self.short.setdefault(len(own), []).append((int(shingles(own, np.array([0, len(own)]), len(own))[0][0]), ids[i + k]))
                if len(own) >= SIZE:
                    by.setdefault(len(own), []).append((ids[i + k], own))
                    known.append(pairs_of(own))
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        # A first look at 16 bits of a pair spares most the search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.lengths = [Items(np.array([i for i, _ in v]), [h for _, h in v]) for _, v in sorted(by.items())]

    def _equal(self, h: np.ndarray, row: np.ndarray, first: np.ndarray, size: int, items: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
        """As search(), for items of fewer than SIZE words: windows of the same words."""
        if len(h) < size:
            return
        window = shingles(h, np.array([0, len(h)]), size)[0]
        wanted = np.array([x for x, _ in items], np.uint64)
        at = np.flatnonzero(np.isin(window, wanted))
        at = at[at + size <= first[row[at] + 1]]
        pair = np.stack([row[at].astype(np.uint64), window[at]], axis=1)
        new, place = np.unique(pair, axis=0, return_index=True)
        for (r, x), k in zip(new.tolist(), at[place].tolist(), strict=True):
            for item in sorted(i for y, i in items if y == x):
                yield int(r), item, int(k - first[r]), size, 1.0

    def search(self, h: np.ndarray, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of every row's best window for every item."""
        for size, items in self.short.items():
            yield from self._equal(h, row, first, size, items)
        if not len(self.known) or len(h) < SIZE:
            return
        pair = pairs_of(h)
        hit = self.maybe[(pair >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        at = at[self.known[np.minimum(np.searchsorted(self.known, pair[at]), len(self.known) - 1)] == pair[at]]
        at = at[row[at] == row[at + 1]]
        sums = np.zeros(len(h), np.int32)
        sums[at + 1] = 1
        sums = np.cumsum(sums, dtype=np.int32)  # sums[i]: known pairs that end at word i or before
        row_end, row_last = first[row + 1], first[1:] - 1
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for items in self.lengths:
            n = items.size
            # Shorter documents with enough shingles stand as one window each, if enough of their pairs are known.
            lengths, m = np.diff(first), n - SIZE + 1
            short = np.flatnonzero((lengths < n) & (lengths >= SIZE) & (lengths - SIZE + 1 >= THRESHOLD * m - 1e-9))
            short = short[sums[row_last[short]] - sums[first[short]] >= items.need]
            for r in short.tolist():
                own = h[first[r] : first[r + 1]]
                _, item = items.within(fingerprints(votes(own), np.zeros(1, np.int64), len(own)))
                own = shingles(own, np.array([0, len(own)]), SIZE)[0]
                for k in np.unique(item).tolist():
                    like = similarity(own, items.shingles[k])
                    if like >= THRESHOLD:
                        best[r, int(items.ids[k])] = (like, 0, len(own) + SIZE - 1)
            if n > len(h):
                continue
            start = np.flatnonzero(sums[n - 1 :] - sums[: len(h) - n + 1] >= items.need)
            start = start[start + n <= row_end[start]]
            gaps = np.flatnonzero(np.diff(start) > 512) + 1
            for some in (part[k : k + 4096] for part in np.split(start, gaps) for k in range(0, len(part), 4096)):
                low = int(some[0])
                near = h[low : int(some[-1]) + n]
                w, item = items.within(fingerprints(votes(near), some - low, n))
                if not len(w):
                    continue
                own, m = shingles(near, np.array([0, len(near)]), SIZE)[0], n - SIZE + 1
                for k in np.unique(item).tolist():
                    # A window's shingles that the item has at all bound what the two share.
                    sums_k = np.concatenate([[0], np.cumsum(np.isin(own, items.shingles[k]))])
                    at = some[w[item == k]] - low
                    for x in at[sums_k[at + m] - sums_k[at] >= THRESHOLD * m].tolist():
                        key = (int(row[low + x]), int(items.ids[k]))
                        if best.get(key, (0.0,))[0] < 1:
                            like = similarity(own[x : x + m], items.shingles[k])
                            if like >= THRESHOLD and like > best.get(key, (0.0,))[0]:
                                best[key] = (like, low + x - int(first[key[0]]), n)
        for (r, item), (like, s, n) in sorted(best.items()):
            yield r, item, s, n, like


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) → doc_id, item_id, start_word, n_words, similarity."""
    spark = docs.sparkSession
    shared.ship(spark)
    benchmark = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-size.n // SLICE), -(-size.bytes // SLICE_BYTES))

    def one(k: int) -> DataFrame:
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(([r.item_id for r in mine], [r.text for r in mine]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(*index.value)
            for batch in batches:
                for i, j, data, offsets in runs(batch["text"]):
                    ids = batch["doc_id"].slice(i, j - i)
                    found = list(known.search(*words(data, offsets)))
                    if found:
                        r, item, s, n, like = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(item), pa.array(s), pa.array(n), pa.array(like)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        return docs.mapInArrow(shared.lean(each), SCHEMA)

    return reduce(DataFrame.unionByName, [one(k) for k in range(slices)])


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items in all documents."""
    return matches(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
