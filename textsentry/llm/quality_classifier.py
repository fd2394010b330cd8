"""Supervised subword embeddings: hashed vectors of words and character n-grams, averaged and fed to a softmax.

Every feature of a text is a bucket: its words, its n-grams of code points and a mark
for each word equal to the one before.  A bucket has a learned vector; a text
is the mean of its vectors; a softmax over the mean gives the classes.  The
training is stochastic gradient descent in numpy on a bounded sample.

As the mean and the output layer are linear, a text's logits are the mean of
``vectors @ output`` over its buckets: scoring gathers one row a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import tidied, unit_hash
from textsentry.llm._text import _STEP, Words, chunks, mix, raw

GRAMS = (3, 5)


def features(off: np.ndarray, data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, borders of the rows) one kind of feature at a time: words, repeats, n-grams of each size in ``GRAMS``."""
    shift = np.uint64(64 - bits)
    w = Words(off, data)
    yield (w.hash >> shift).astype(np.int64), w.at
    again = np.zeros(len(w.hash), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.at[:-1][w.at[:-1] < len(again)]] = False
    # a repeat and a fresh word are one bucket each, the last two
    yield np.where(again, (1 << bits) - 1, (1 << bits) - 2), w.at
    body = data[off[0] : off[-1]]
    # the first byte of each character is none that continues one
    at = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[off - off[0]]
    text = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    for n in GRAMS:
        places = max(0, len(text) - n + 1)
        code = np.zeros(places, np.uint64)
        for k in range(n):
            code += text[k : places + k] * _STEP[k]
        # n-grams that reach into the next row go to no row
        count = np.maximum(np.diff(at) - n + 1, 0)
        border = np.concatenate(([0], np.cumsum(count)))
        if int(border[-1]) != len(code):
            take = np.arange(int(border[-1])) - np.repeat(border[:-1], count) + np.repeat(at[:-1], count)
            code = code[take]
        yield (mix(code + np.uint64(n << 56)) >> shift).astype(np.int64), border


def _sums(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (n x classes) between borders."""
    run = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return run[border[1:]] - run[border[:-1]]


class Model:
    """``table``: buckets x classes, the product of vectors and output; ``bias``: of the classes."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, bits: int):
        self.table, self.bias, self.bits = table, bias, bits

    def probabilities(self, col: pa.Array) -> np.ndarray:
        """Rows x classes.  A text without features has the probabilities of the bias."""
        off, data = raw(col)
        out = np.empty((len(off) - 1, len(self.bias)))
        for a, b in chunks(off):
            sums, count = np.zeros((b - a, len(self.bias))), np.zeros(b - a)
            for bucket, border in features(off[a : b + 1], data, self.bits):
                sums += _sums(self.table[bucket], border)
                count += np.diff(border)
            logit = sums / np.maximum(count, 1)[:, None] + self.bias
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            out[a:b] = e / e.sum(axis=1, keepdims=True)
        return out


def train(texts: list[str], classes: np.ndarray, *, n_classes: int = 2, bits: int = 17, dim: int = 8, epochs: int = 12, rate: float = 30.0, seed: int = 1) -> Model:
    """SGD, one text a step, with a rate that falls to zero.

    The gradient reaches each vector divided by the number of features, so
    that ``rate`` is large.  The bias starts at the classes' log shares.  No
    texts give equal probabilities.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output = np.zeros((dim, n_classes), np.float32)
    share = np.bincount(classes, minlength=n_classes).astype(np.float64) + 1
    bias = np.log(share / share.sum())
    bags = []
    for t in texts:
        off, data = raw(pa.array([t]))
        found, count = np.unique(np.concatenate([f for f, _ in features(off, data, bits)]), return_counts=True)
        bags.append((found, (count / max(1, count.sum())).astype(np.float32)))
    steps = epochs * len(bags)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = 1 - done / steps
            done += 1
            found, weight = bags[i]
            mean = weight @ vectors[found]
            logit = mean @ output + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[classes[i]] -= 1
            back = output @ p.astype(np.float32)
            output -= np.float32(0.5 * lr) * np.outer(mean, p).astype(np.float32)
            vectors[found] -= np.float32(rate * lr) * np.outer(weight, back)
            bias -= 0.02 * lr * p
    return Model((vectors @ output).astype(np.float32), bias, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", rows: int = 4000) -> tuple[list[str], list[int]]:
    """About ``rows`` texts with their labels, drawn by a hash of the key; in the order of the keys.

    Rows with a null key or label are left out; a null text counts as empty.
    The bound is on rows, so the driver holds ``rows`` whole texts.
    """
    marks = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).dropna()
    total = marks.count()
    if total > rows:
        marks = marks.where(unit_hash(F.col("__key"), seed=1) < rows / total)
    drawn = docs.join(F.broadcast(marks.limit(2 * rows)), F.col(key) == F.col("__key")).select("__key", "__label", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = sorted(tuple(r) for r in drawn.limit(2 * rows).collect())
    return [r[2] for r in found], [r[1] for r in found]


def scored(docs: DataFrame, model: Model, *, keep: tuple[str | Column, ...] = ("doc_id",), text: str = "text", least: float = 0.7) -> DataFrame:
    """The ``keep`` columns, ``score`` = P(class 1) of the whole text and ``predicted`` = 1 from ``least`` on.

    Null and empty texts have no features; the class shares decide.
    """
    names = [*docs.select(*keep).columns, "score", "predicted"]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(batch.column(batch.num_columns - 1))[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= least).astype(np.int32))], names=names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(tidied(run), schema)
