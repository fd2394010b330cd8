"""Benchmark passages in documents: SimHash windows, multi-index Hamming search, exact similarity.

A window has as many words as an item.  Its fingerprint is the SimHash of its
five-word shingles, 64 bits; all windows that share a shingle with any item
get one (a window that shares none has similarity 0).  Fingerprints are cut
into five blocks; if two differ in at most ``radius`` bits, some block differs
in at most ``radius // 5``, so an index from each block's values, with all
their neighbours, to the items finds every pair within the radius.  Only the
items that it names are compared.  A pair counts if its
weighted-shingle similarity, computed exactly, is at least ``similarity``:
sum of the lesser over sum of the greater counts of each shingle, weighted by
its rarity among the items.

Items are a stated query set: at most ``most_items``, checked before they are
sent to the workers in blocks of ``block_items``, so that a task holds the
texts and tables of one block.  Rarity is that among all items: with several blocks a
task also holds the counts of the shingles that several items share, 16 bytes
each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import tidied
from textsentry.llm._text import Words, chunks, raw, sets_of, words_of

WORDS = 5
#: Bits of the fingerprint's blocks, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
_CHUNK = 1 << 19


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash of rows of 64 bit sums."""
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def signs(grams: np.ndarray) -> np.ndarray:
    """n x 64: 1 or -1 for each bit of each hash."""
    bits = np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


#: Number of items with words; shingles that several items have, sorted, and in how many.
Rarity = tuple[int, np.ndarray, np.ndarray]


class Hamming:
    """Multi-index over fingerprints: from the values of a block, with their neighbours, to the fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        shift, flips = 0, radius // len(BLOCKS)
        for bits in BLOCKS:
            masks = np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)
            mask = np.uint64((1 << bits) - 1)
            values = ((prints >> np.uint64(shift)) & mask)[:, None] ^ masks
            order = np.argsort(values.ravel(), kind="stable")
            start = np.concatenate(([0], np.cumsum(np.bincount(values.ravel().astype(np.int64), minlength=1 << bits))))
            self.tables.append((np.uint64(shift), mask, start, (order // len(masks)).astype(np.int32)))
            shift += bits

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in ``codes``, place in the fingerprints) within the radius, in this order."""
        found = []
        for shift, mask, start, ids in self.tables:
            value = ((codes >> shift) & mask).astype(np.int64)
            n = start[value + 1] - start[value]
            which = np.repeat(np.arange(len(codes)), n)
            item = ids[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[value], n)]
            near = np.bitwise_count(self.prints[item] ^ codes[which]) <= self.radius
            found.append(which[near] * len(self.prints) + item[near])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


class Index:
    """Items (id, text), their shingles with counts, and a multi-index for each size in words; ``rarity`` is needed if there are other items besides."""

    def __init__(self, items: list[tuple[int, str]], radius: int, rarity: Rarity | None = None):
        self.items: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        own: list[np.ndarray] = []
        for (item, _), (_, _, w) in zip(items, (x for t in items for x in words_of(pa.array([t[1] or ""], pa.string())))):
            grams = w.grams(WORDS)[0]
            if len(grams):
                own.append(grams)
                self.items.append((item, len(w.hash), *np.unique(grams, return_counts=True)))
        self.known, seen = np.unique(np.concatenate([x[2] for x in self.items] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.total, self.shared, self.counts = rarity or (len(self.items), self.known[seen > 1], seen[seen > 1])
        self.small = np.zeros(1 << 20, bool)
        self.small[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.weights = [self.weight(x[2]) for x in self.items]
        self.sizes: dict[int, tuple[list[int], Hamming]] = {}
        for size in sorted({n for _, n, _, _ in self.items}):
            mine = [i for i, x in enumerate(self.items) if x[1] == size]
            self.sizes[size] = mine, Hamming(np.concatenate([fingerprint(signs(own[i]).sum(axis=0)[None]) for i in mine]), radius)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of an item."""
        out = self.small[(grams >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
            out[at] = self.known[place] == grams[at]
        return out

    def weight(self, grams: np.ndarray) -> np.ndarray:
        """Rarity of each shingle among all items; one that no two items share is as rare as can be."""
        share = np.ones(len(grams))
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, grams), len(self.shared) - 1)
            share = np.where(self.shared[at] == grams, self.counts[at], 1)
        return np.log(1 + self.total / share)

    def similarity(self, item: int, grams: np.ndarray, weight: float) -> float:
        """Of an item and a window, given by its shingles and the sum of their weights."""
        _, _, mine, count = self.items[item]
        window = np.sort(grams)
        theirs = np.searchsorted(window, mine, "right") - np.searchsorted(window, mine, "left")
        same = float(self.weights[item] @ np.minimum(count, theirs))
        return same / (float(self.weights[item] @ count) + weight - same)

    def matches(self, words: Words, row: int, similarity: float) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of each item's best window in one text; the first of equals."""
        a, b = int(words.at[row]), int(words.at[row + 1])
        if a == b:
            return []
        grams = self.grams[self.border[row] : self.border[row + 1]]
        best: dict[int, tuple[float, int, int]] = {}
        hit = self.found[self.border[row] : self.border[row + 1]]
        if hit.any():
            run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(grams), axis=0, dtype=np.int32)))
            many = np.concatenate(([0], np.cumsum(hit)))
            weight = np.concatenate(([0.0], np.cumsum(self.weight(grams))))
            for size, (mine, index) in self.sizes.items():
                span = min(max(1, size - WORDS + 1), len(grams))
                starts = np.arange(len(grams) - span + 1)
                starts = starts[many[starts + span] > many[starts]]
                if not len(starts):
                    continue
                codes = fingerprint(run[starts + span] - run[starts])
                for at, j in zip(*(x.tolist() for x in index.pairs(codes))):
                    s = int(starts[at])
                    value = self.similarity(mine[j], grams[s : s + span], weight[s + span] - weight[s])
                    if value >= similarity - 1e-12 and value > best.get(mine[j], (0.0,))[0] + 1e-12:
                        best[mine[j]] = (value, s, min(size, b - a))
        # items of fewer words than a shingle have one, which is also looked for among shorter word runs
        for size in [n for n in self.sizes if n < WORDS and n < b - a]:
            for j, at in self.short(words, row, size):
                best.setdefault(j, (1.0, at, size))
        return [(self.items[j][0], *v) for j, v in sorted(best.items())]

    def short(self, words: Words, row: int, size: int) -> list[tuple[int, int]]:
        grams, border = words.grams(size)
        mine = grams[border[row] : border[row + 1]]
        return [(j, int(at[0])) for j in self.sizes[size][0] if len(at := np.flatnonzero(mine == self.items[j][2][0]))]

    def of(self, col: pa.Array, similarity: float) -> Iterator[list[tuple[int, float, int, int]]]:
        off, data = raw(col)
        for a, b in chunks(off, _CHUNK):
            words = Words(off[a : b + 1], data)
            self.grams, self.border = words.grams(WORDS)
            self.found = self.hits(self.grams)
            for row in range(b - a):
                yield self.matches(words, row, similarity)


def _rarity(items: DataFrame) -> Rarity:
    """Counted by Spark over all items (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in sets_of(batch.column(0), WORDS):
                # one row more for each item with words
                n = min(1, len(grams))
                yield pa.RecordBatch.from_arrays([pa.array([*grams.view(np.int64).tolist(), *[None] * n], pa.int64())], names=["g"])

    counts = items.select("t").mapInArrow(tidied(run), "g long").groupBy("g").count().where("count > 1 or g is null").toArrow()
    g, n = counts.column("g").combine_chunks(), counts.column("count").to_numpy()
    whole = np.asarray(g.is_null())
    grams = g.fill_null(0).to_numpy()[~whole].view(np.uint64)
    order = np.argsort(grams)
    return int(n[whole].sum()), grams[order], n[~whole][order]


def _blocks(benchmark: DataFrame, key: str, text: str, block_items: int, most_items: int) -> Iterator[tuple[list[tuple[int, str]], Rarity | None]]:
    items = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("length(t) > 0")
    n = items.count()
    if n > most_items:
        raise ValueError(f"{n} items: split the benchmark, a run takes up to {most_items}")
    blocks = -(-n // block_items)
    rarity = _rarity(items) if blocks > 1 else None
    for i in range(blocks):
        yield sorted((tuple(r) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i).collect()), key=str), rarity


def matched(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 18, block_items: int = 5000, most_items: int = 1_000_000) -> DataFrame:
    """``key``, ``item_key``, similarity, at_word and n_words: one row for each document row and item in it, with its best window.

    Null and empty texts and items match nothing.  A text shorter than an item
    is compared whole.  Items of fewer than five words match only word for
    word.  Without items the result is empty.
    """
    names = [key, item_key, "similarity", "at_word", "n_words"]
    schema = docs.select(key).schema.add(item_key, "long").add("similarity", "double").add("at_word", "long").add("n_words", "long")
    out = docs.sparkSession.createDataFrame([], schema)
    for items, rarity in _blocks(benchmark, item_key, item_text, block_items, most_items):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = items, rarity: Rarity | None = rarity) -> Iterator[pa.RecordBatch]:
            index = Index(items, radius, rarity)
            for batch in batches:
                rows = [(i, *m) for i, found in enumerate(index.of(batch.column(1), similarity)) for m in found]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=names)

        out = out.unionByName(docs.select(key, text).mapInArrow(tidied(run), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 18, block_items: int = 5000, most_items: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that hold an item, as :func:`matched` finds them; nothing is shuffled.

    Rows with a null or empty text stay, as do all without items.
    """
    at = docs.columns.index(text)
    for items, rarity in _blocks(benchmark, item_key, item_text, block_items, most_items):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = items, rarity: Rarity | None = rarity) -> Iterator[pa.RecordBatch]:
            index = Index(items, radius, rarity)
            for batch in batches:
                yield batch.filter(pa.array([not found for found in index.of(batch.column(at), similarity)], pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
