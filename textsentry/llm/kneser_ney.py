"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map into memory.

Tokens are a text's words and one end mark; the first token's context is a
start mark.  Training takes two passes and keeps nothing unbounded anywhere:

1. words: partial counts per task, dealt by the top bits of the word's hash;
   each bucket is merged and written as a sorted array of hashes with counts.
   A word's number is its place over all buckets.
2. pairs of numbers: partial counts per task, dealt by a hash of the pair, so
   that a frequent context is spread; each bucket is written as a sorted array
   of pairs with counts.  Context sums and continuation counts go on to ranges
   of word numbers and are written as dense arrays.

The number of buckets follows the size of the input; that of ranges is 2**14 at
most.  Scoring maps the files that a block of texts asks for, a bounded number
at a time, and looks up all tokens of the block at once, in sorted order.

The files lie in the folder of ``spark.checkpoint.dir``, which must be
reachable as a path by all executors; they stay until that folder is cleared.
Words are told apart by 64-bit hashes.  ``log10`` is used throughout.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import local_path, shared_dir, tidied
from textsentry.llm._text import Words, chunks, mix, raw

END = np.uint64(0xE4D0F7E47E4D0F7E)
RANGE = 1 << 18
_FLUSH = 2_000_000
_STATS = ("count", "one", "two", "more", "cont")


@dataclass
class Model:
    """Where the files are, and what is known of the whole."""

    path: str
    bits: int
    tokens: int = 0
    bases: list[int] = field(default_factory=lambda: [0])
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    types: int = 0
    rest: float = 0.0

    @property
    def vocabulary(self) -> int:
        return self.bases[-1]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts of counts; one half of the count where they cannot be told."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the tokens of each row, ends included; row borders; bytes are not kept."""
    w = Words(off, data)
    return np.insert(w.hash, w.at[1:], END), w.at + np.arange(len(w.at)), len(w.hash)


def _write(path: str, name: str, array: np.ndarray) -> None:
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    array.tofile(temporary)
    os.replace(temporary, f"{path}/{name}")


class _Maps:
    """Files of a model mapped into memory when asked for, at most ``most`` at a time."""

    def __init__(self, path: str, most: int = 1024):
        self.path, self.most = path, most
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def __call__(self, name: str, kind: type) -> np.ndarray:
        if name not in self.open:
            full = f"{self.path}/{name}"
            self.open[name] = np.memmap(full, kind, "r") if os.path.exists(full) and os.path.getsize(full) else np.zeros(0, kind)
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Batch:
    """Rows (bucket, n, body) in pieces that fit an Arrow batch."""

    schema = "bucket int, n long, body binary"

    @staticmethod
    def of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "n", "body"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and row borders of the training texts, about ``_FLUSH`` tokens at a time."""
    tokens, borders, held = [], [], 0
    for batch in batches:
        off, data = raw(batch.column(0))
        for a, b in chunks(off):
            t, at, _ = _tokens(off[a : b + 1], data)
            tokens.append(t)
            borders.append(at[:-1] + held)
            held += len(t)
            if held >= _FLUSH:
                yield np.concatenate(tokens), np.concatenate(borders)
                tokens, borders, held = [], [], 0
    if held:
        yield np.concatenate(tokens), np.concatenate(borders)


class Reader:
    """Lookups in the mapped files of a model, in the order of the keys, so that a file is asked for once a block."""

    def __init__(self, model: Model, most: int = 1024):
        self.model, self.maps = model, _Maps(model.path, most)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, or the size of the vocabulary if unknown; count) of each word hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number = np.full(len(distinct), self.model.vocabulary, np.int64)
        count = np.zeros(len(distinct), np.int64)
        for i, a, b in _runs(distinct >> np.uint64(64 - self.model.bits)):
            words = self.maps(f"word-{i}", np.uint64)
            if len(words):
                at = np.minimum(np.searchsorted(words, distinct[a:b]), len(words) - 1)
                hit = words[at] == distinct[a:b]
                number[a:b] = np.where(hit, at + self.model.bases[i], number[a:b])
                count[a:b] = np.where(hit, self.maps(f"word-count-{i}", np.int64)[at], 0)
        return number[back], count[back]

    def pair_count(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        bucket = _bucket(distinct, self.model.bits)
        order = np.argsort(bucket, kind="stable")
        count = np.zeros(len(distinct), np.int64)
        for i, a, b in _runs(bucket[order]):
            pairs, mine = self.maps(f"pair-{i}", np.uint64), order[a:b]
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, distinct[mine]), len(pairs) - 1)
                count[mine] = np.where(pairs[at] == distinct[mine], self.maps(f"pair-count-{i}", np.int64)[at], 0)
        return count[back]

    def stat(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """A dense statistic of each number; 0 beyond the arrays."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for i, a, b in _runs(distinct // RANGE):
            values = self.maps(f"{name}-{i}", np.int64)
            if len(values):
                out[a:b] = values[distinct[a:b] - i * RANGE]
        return out[back]

    def probabilities(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """P(token | context); ``before`` is the vocabulary's size + 1 for the start, its size for an unknown context."""
        m = self.model
        cont = self.stat("cont", number)
        low = _kept(cont, m.word_discounts) / max(1, m.types) + m.rest / (m.vocabulary + 1)
        key = _pair(before, number)
        count = np.where(number < m.vocabulary, self.pair_count(key), 0)
        total = self.stat("count", before)
        weight = sum(d * self.stat(s, before) for d, s in zip(m.pair_discounts, ("one", "two", "more")))
        seen = np.maximum(total, 1)
        return np.where(total > 0, _kept(count, m.pair_discounts) / seen + weight / seen * low, low)


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first place, place behind the last) of each run of equal keys."""
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sorted_keys)]) if len(sorted_keys) else ():
        yield int(sorted_keys[a]), a, b


def _kept(count: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return count - np.array([0.0, *discount])[np.minimum(count, 3)]


def _pair(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _contexts(number: np.ndarray, starts: np.ndarray, vocabulary: int) -> np.ndarray:
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[starts] = vocabulary + 1
    return before


def fit(docs: DataFrame, *, text: str = "text", bucket_bytes: int = 32 << 20) -> Model:
    """Count ``docs`` whole; null texts are empty texts, which still have their end.  The vocabulary may have up to 2**32 - 2 words."""
    spark = docs.sparkSession
    path = local_path(f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}")
    if path is None:
        raise ValueError("the model is mapped into memory: spark.checkpoint.dir must be a path that all executors share")
    os.makedirs(path)
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))))).first()[0] or 0
    bits = max(2, (int(size) // bucket_bytes).bit_length())
    docs = docs.select(text)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _blocks(batches):
            found, n = np.unique(tokens, return_counts=True)
            border = np.searchsorted(found >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            yield _Batch.of([(i, b - a, _pack(found[a:b], n[a:b].astype(np.int64))) for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist())) if a < b])

    def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [], []
        for n, body in zip(rows.column("n").to_pylist(), rows.column("body")):
            flat = zstd.decompress(body.as_py())
            keys.append(np.frombuffer(flat, np.uint64, n))
            counts.append(np.frombuffer(flat, np.int64, n, 8 * n))
        return _summed(np.concatenate(keys), np.concatenate(counts))

    def write_words(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        keys, counts = read(rows)
        _write(path, f"word-{bucket}", keys)
        _write(path, f"word-count-{bucket}", counts)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())]})

    found = {r[0]: r for r in docs.mapInArrow(tidied(count_words), _Batch.schema).groupBy("bucket").applyInArrow(write_words, "bucket int, types long, tokens long").collect()}
    model = Model(path, bits, sum(r[2] for r in found.values()))
    for i in range(1 << bits):
        model.bases.append(model.bases[-1] + (found[i][1] if i in found else 0))
    if model.vocabulary >= (1 << 32) - 2:
        raise ValueError("more words than 32 bits can number")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for tokens, starts in _blocks(batches):
            number, _ = reader.numbers(tokens)
            keys, n = np.unique(_pair(_contexts(number, starts, model.vocabulary), number), return_counts=True)
            bucket = _bucket(keys, bits)
            order = np.argsort(bucket, kind="stable")
            keys, n, border = keys[order], n[order], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            rows = []
            for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist())):
                if a < b:
                    high = (keys[a:b] >> np.uint64(32)).astype(np.uint32)
                    rows.append((i, b - a, _pack(np.diff(high, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T, keys[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T, n[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T)))
            yield _Batch.of(rows)

    def unpack(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(zstd.decompress(body), np.uint8).reshape(3, 4, n)
        high, low, count = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in flat)
        return (np.cumsum(high, dtype=np.uint64) << np.uint64(32)) | low, count.astype(np.int64)

    def write_pairs(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        parts = [unpack(n, body.as_py()) for n, body in zip(rows.column("n").to_pylist(), rows.column("body"))]
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _write(path, f"pair-{bucket}", keys)
        _write(path, f"pair-count-{bucket}", counts)
        before, number = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = []
        context = {"count": counts, "one": counts == 1, "two": counts == 2, "more": counts > 2}
        first = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        sums = {s: np.add.reduceat(v.astype(np.int64), first) for s, v in context.items()}
        word, cont = np.unique(number, return_counts=True)
        for base, ids, columns in ((0, before[first], sums), (4, word, {"cont": cont.astype(np.int64)})):
            border = np.searchsorted(ids, np.arange(0, model.vocabulary + 2 + RANGE, RANGE))
            for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist())):
                if a < b:
                    out += [(i, base + k, b - a, _pack(ids[a:b], v[a:b])) for k, v in enumerate(columns.values())]
        # the last range stands for the counts of counts
        out.append((-1, 0, 4, _pack(np.arange(4), np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64))))
        out.append((-1, 1, 1, _pack(np.arange(1), np.array([len(keys)], np.int64))))
        cols = list(zip(*out))
        return pa.table({"range": pa.array(cols[0], pa.int32()), "stat": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int64()), "body": pa.array(cols[3], pa.binary())})

    def dense(rows: pa.Table, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        base = max(0, rows.column("range")[0].as_py()) * RANGE
        for n, body in zip(rows.column("n").to_pylist(), rows.column("body")):
            flat = zstd.decompress(body.as_py())
            out[np.frombuffer(flat, np.int64, n) - base] += np.frombuffer(flat, np.int64, n, 8 * n)
        return out

    def write_stats(rows: pa.Table) -> pa.Table:
        at, stat = rows.column("range")[0].as_py(), rows.column("stat")[0].as_py()
        name = _STATS[stat] if at >= 0 else ("pairs", "types")[stat]
        values = dense(rows, RANGE if at >= 0 else 4)
        if at >= 0:
            _write(path, f"{name}-{at}", values)
        kept = [int((values == k).sum()) for k in (1, 2, 3, 4)] + [int((values > 2).sum())] if at >= 0 else values.tolist() + [0]
        return pa.table({"name": [name], "c": pa.array([kept if name in ("cont", "pairs", "types") else [0] * 5], pa.list_(pa.int64()))})

    stats = docs.mapInArrow(tidied(count_pairs), _Batch.schema).groupBy("bucket").applyInArrow(write_pairs, "range int, stat int, n long, body binary")
    sums: dict[str, np.ndarray] = {}
    for name, c in stats.groupBy("range", "stat").applyInArrow(write_stats, "name string, c array<long>").collect():
        sums[name] = sums.get(name, np.zeros(5, np.int64)) + np.array(c)
    if sums:
        model.pair_discounts = discounts(*sums["pairs"][:4].tolist())
        model.word_discounts = discounts(*sums["cont"][:4].tolist())
        model.types = int(sums["types"][0])
        one, two, more = int(sums["cont"][0]), int(sums["cont"][1]), int(sums["cont"][4])
        model.rest = sum(d * n for d, n in zip(model.word_discounts, (one, two, more))) / model.types
    else:
        model.rest = 1.0
    return model


def scored(docs: DataFrame, model: Model, *, keep: tuple[str | Column, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and perplexity, over whole texts.

    A null or empty text has its end mark as the only token.  Without training
    texts all tokens are unknown and equally likely.  Equal texts score alike.
    """
    extra = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    names = [*docs.select(*keep).columns, *extra]
    schema = docs.select(*keep).schema
    for k, v in extra.items():
        schema = schema.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        scale = np.log10(model.tokens + model.vocabulary + 1)
        for batch in batches:
            off, data = raw(batch.column(batch.num_columns - 1))
            n, known, base, score = (np.zeros(len(off) - 1, k) for k in (np.int64, np.int64, np.float64, np.float64))
            for a, b in chunks(off):
                tokens, at, _ = _tokens(off[a : b + 1], data)
                number, count = reader.numbers(tokens)
                p = reader.probabilities(_contexts(number, at[:-1], model.vocabulary), number)
                n[a:b] = np.diff(at)
                known[a:b] = np.add.reduceat((count > 0).astype(np.int64), at[:-1])
                base[a:b] = np.add.reduceat(np.log10(count + 1.0) - scale, at[:-1])
                score[a:b] = np.add.reduceat(np.log10(p), at[:-1])
            columns = [n, known, np.full(len(n), model.tokens), base, score, 10 ** np.minimum(300.0, -score / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(tidied(run), schema)
