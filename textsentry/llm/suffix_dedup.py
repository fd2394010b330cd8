"""Removal of byte strings that repeat, found with suffix arrays and longest previous factors.

A byte goes if a string of ``length`` bytes over it also starts elsewhere, in
the same text or another.  With ``keep="none"`` every such byte goes, with
``keep="first"`` the earliest occurrence stays (by id, then place).  Several
lengths can be asked for at once; ``least`` is the shortest, ``most`` the
longest of them.

No suffix array of a whole corpus fits one machine, so the places where a
string may start are dealt by content.  A place's anchor is the least hash of
``GRAM`` bytes in the ``least`` bytes from it on; strings that agree for
``least`` bytes have equal anchors at the same distance, so all that a place
can match lies in its anchor's group.  Neighbouring places with one anchor form
a segment, which has the bytes from its first place to ``most`` bytes after its
last.

1. Anchors that occur once are dropped.
2. Segments equal in all bytes are one kind; a kind that occurs twice repeats
   whole, without looking at its text again.
3. Anchors with several kinds get the kinds' bytes.  The suffix array of a
   group's places, compared for ``most`` bytes, gives the longest common
   prefixes of neighbours; previous and next smaller positions in suffix order
   give each place's longest previous factor, previous and next greater ones
   its longest next factor.  A place repeats for a length that its factor
   reaches.
4. Groups of more than ``hot`` kinds, which one task should not hold, are dealt
   anew for each length by blocks of ``BLOCK`` neighbouring places: strings that
   agree lie in blocks with equal cores (the bytes that all strings of the
   block have).  Step 2 follows for these; blocks of several kinds are dealt by
   whole strings, which are counted in a partial aggregation.

Anchors and kinds have 64 bits each and are compared together; texts are told
apart by the 128 bits of their MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import Scope, tidied
from textsentry.llm._text import chunks, mix, raw

#: Stands for a null id: such rows come last.
LAST = (1 << 63) - 1
BLOCK = 16

GRAM = 32
_BITS = 26
_BYTE = mix(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_JOIN = mix(np.arange(900, 910, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    h, n = _BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * _JOIN[n.bit_length()] + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    return mix(h)


def _least(h: np.ndarray, want: int) -> np.ndarray:
    """Place of the least of ``want`` hashes from each place on, the leftmost of equals."""
    mask = np.uint64((1 << _BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    return (low & mask).astype(np.int64)


def anchors(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of runs of windows that have the same anchor.

    A window is ``length`` bytes of one row; its anchor is the least hash of
    ``GRAM`` bytes in it, the leftmost of equals.  Equal windows have their
    anchors at the same place.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    h, want = gram_hashes(data), length - GRAM + 1
    # places have _BITS bits: longer data is done in pieces that overlap by a window
    step = (1 << _BITS) - want + 1
    anchor = np.concatenate([_least(h[a : a + step + want - 1], want) + a for a in range(0, len(h) - want + 1, step)])
    row_end = np.repeat(borders[1:], np.diff(borders))[: len(anchor)]
    good = np.arange(len(anchor)) + length <= row_end
    first = good.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1]
    last = good.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~good[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, anchor[lo], h[anchor[lo]]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("t"), body.alias("body"))


def _place(t: pa.Array, lo: np.ndarray) -> np.ndarray:
    """A number below 2**62 for each text and place."""
    head = np.array([int.from_bytes(x[:8]) for x in t.to_pylist()], np.uint64)
    return (mix(head + mix(lo.astype(np.uint64) + np.uint64(1))) >> np.uint64(2)).astype(np.int64)


def _segments(rows: DataFrame, least: int, most: int) -> DataFrame:
    """id, t, lo and hi (first and last place), end of its bytes, anchor, kind.

    Of a kind that occurs several times in a text, the first place stands for
    all.  ``p`` and ``q`` are a number of text and place, differing by one if
    it stands for several: a kind occurs once if the least p is the greatest q.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = raw(batch.column(2))
            for a, b in chunks(off):
                base = off[a]
                text = data[base : off[b]]
                at = off[a : b + 1] - base
                lo, hi, anchor, code = anchors(text, at, least)
                row = np.searchsorted(at, lo, "right") - 1
                end = np.minimum(hi + most, at[row + 1])
                whole = text.tobytes()
                kind = np.fromiter((xxhash.xxh3_64_intdigest(whole[x:z], (p - x) << 20 | (y - x)) for x, y, z, p in zip(lo.tolist(), hi.tolist(), end.tolist(), anchor.tolist())), np.uint64, len(lo))
                order = np.lexsort((lo, kind, code, row))
                same = (row[order][1:] == row[order][:-1]) & (code[order][1:] == code[order][:-1]) & (kind[order][1:] == kind[order][:-1])
                first = np.concatenate(([True], ~same))[: len(order)]
                many = np.concatenate((same, [False]))[: len(order)]
                take, many = order[first], many[first]
                src = pa.array(row[take] + a)
                start = at[row[take]]
                t = batch.column(1).take(src)
                p = _place(t, lo[take] - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(src), t, *(pa.array((x[take] - start).astype(np.int32)) for x in (lo, hi, end)), pa.array(code[take].view(np.int64)), pa.array(kind[take].view(np.int64)), pa.array(p), pa.array(p + many)],
                    names=["id", "t", "lo", "hi", "end", "anchor", "kind", "p", "q"],
                )

    return rows.mapInArrow(tidied(run), "id long, t binary, lo int, hi int, end int, anchor long, kind long, p long, q long")


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(x.as_py().encode()) for x in batch.column(2)], pa.binary())], names=["id", "t", "packed"])

    return rows.mapInArrow(tidied(run), "id long, t binary, packed binary")


def suffix_array(text: np.ndarray, starts: np.ndarray, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of ``starts``, longest common prefix of each entry with the one before).

    A suffix has ``room`` bytes and is compared for ``most`` at most.  ``text``
    is padded: beyond a suffix's room it has zeros, which occur nowhere else.
    Equal suffixes keep their order.
    """
    views = np.lib.stride_tricks.sliding_window_view(text, most)[starts]
    order = np.argsort(np.ascontiguousarray(views).view(f"S{most}").ravel(), kind="stable")
    ranked = views[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = ranked[1:] != ranked[:-1]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        common[1:] = np.minimum(length, np.minimum(room[order][1:], room[order][:-1]))
    return order, common


def _to_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest common prefix of each entry of a suffix array with the previous one of a smaller position; 0 if none shares any.

    All entries step to the left at once, each by what the entry it stands at
    has stepped over already.
    """
    jump, low = np.arange(len(position)) - 1, common.copy()
    going = np.flatnonzero(low > 0)
    while True:
        going = going[(low[going] > 0) & (position[jump[going]] > position[going])]
        if not len(going):
            return low
        at = jump[going]
        low[going], jump[going] = np.minimum(low[going], low[at]), jump[at]


def longest_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of each start; starts are numbered in text order.

    The longest previous factor is shared with the previous or the next entry
    in suffix order that has a smaller position; the longest next factor with
    the previous or the next that has a greater one.
    """
    back = np.concatenate((common[:1], common[:0:-1]))
    found = []
    for position in (order, -order):
        best = np.empty(len(order), np.int64)
        best[order] = np.maximum(_to_smaller(position, common), _to_smaller(position[::-1], back)[::-1])
        found.append(best)
    return found[0], found[1]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return a[np.concatenate(([0], cut))], b[np.concatenate((cut - 1, [len(a) - 1]))]


#: id, text, first place, number of places, bytes.
Slice = tuple[int, bytes, int, int, bytes]


def _found(block: list[Slice], lengths: tuple[int, ...], keep: str) -> list[tuple[bytes, int, int, int]]:
    """Repeats among the places of whole groups: (t, start, end, length)."""
    most = max(lengths)
    block = sorted({(x[1], x[2]): x for x in block}.values(), key=lambda x: x[:3])
    places = np.array([x[3] for x in block])
    seg = np.repeat(np.arange(len(block)), places)
    inside = np.arange(len(seg)) - np.repeat(np.cumsum(places) - places, places)
    padded = np.cumsum(places + most - 1)
    base = padded - (places + most - 1)
    text = np.zeros(int(padded[-1]), np.uint8)
    for at, x in zip(base.tolist(), block):
        # no byte of UTF-8 text is 255
        text[at : at + len(x[4])] = np.frombuffer(x[4], np.uint8) + 1
    room = np.minimum(most, np.array([len(x[4]) for x in block])[seg] - inside)
    order, common = suffix_array(text, base[seg] + inside, room, most)
    common[common < min(lengths)] = 0
    previous, following = longest_factors(order, common)
    factor = np.maximum(previous, following) if keep == "none" else previous
    out = []
    for length in lengths:
        gone = np.flatnonzero(factor >= length)
        s, i = seg[gone], inside[gone]
        # strings of a segment that overlap or touch are one span
        cut = np.flatnonzero((s[1:] != s[:-1]) | (i[1:] > i[:-1] + length)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(gone)]) if len(gone) else ():
            x = block[s[a]]
            out.append((x[1], x[2] + int(i[a]), x[2] + int(i[b - 1]) + length, length))
    return out


_SPANS = "t binary, a int, b int, length int"


def _span_batch(spans: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*spans)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int32()))], names=["t", "a", "b", "length"])


def _compared(slices: DataFrame, lengths: tuple[int, ...], keep: str, places: int = 40_000) -> DataFrame:
    """Spans from slices (anchor, then those of ``Slice``), sorted by anchor within partitions; whole groups at a time, several while they are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[Slice] = []
        held, last = 0, None
        for batch in batches:
            for anchor, *x in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and held >= places:
                    yield _span_batch(_found(block, lengths, keep))
                    block.clear()
                    held = 0
                last = anchor
                block.append(tuple(x))
                held += x[3]
        if block:
            yield _span_batch(_found(block, lengths, keep))

    return slices.mapInArrow(tidied(run), _SPANS)


_SLICE = "anchor long, id long, t binary, lo int, n int, body binary"


def _sliced(wanted: DataFrame, packed: DataFrame) -> DataFrame:
    """Bytes of the wanted segments (id, t, segs: array of anchor, lo, hi, end, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            for i, t, segs, z in zip(*(c.to_pylist() for c in batch.columns)):
                body, n = unpack(z), len(segs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["anchor"] for s in segs], pa.int64()), pa.array([i] * n, pa.int64()), pa.array([t] * n, pa.binary()), pa.array([s["lo"] for s in segs], pa.int32()), pa.array([s["hi"] - s["lo"] + 1 for s in segs], pa.int32()), pa.array([body[s["lo"] : s["end"]] for s in segs], pa.binary()), pa.array([s["hot"] for s in segs], pa.bool_())],
                    names=["anchor", "id", "t", "lo", "n", "body", "hot"],
                )

    return wanted.join(packed, ["id", "t"]).select("id", "t", "segs", "packed").mapInArrow(tidied(run), f"{_SLICE}, hot boolean")


def _blocks(slices: DataFrame, length: int, least: int) -> DataFrame:
    """Blocks of places of hot groups: group (hash of anchor, distance and core), kind, id, t, lo, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << _BITS) - 1)
        names = ["anchor", "kind", "id", "t", "lo", "body"]
        for batch in batches:
            out = []
            for anchor, i, t, lo, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                at = int(np.argmin(gram_hashes(np.frombuffer(body, np.uint8, least)) & ~mask))
                n = min(n, len(body) - length + 1)
                for j in range(max(0, (at - n + 1) // BLOCK), at // BLOCK + 1) if n > 0 else ():
                    x, y = max(0, at - BLOCK * j - BLOCK + 1), min(n - 1, at - BLOCK * j)
                    part = body[x : y + length]
                    core = body[at - BLOCK * j : at - BLOCK * j - BLOCK + 1 + length]
                    group = xxhash.xxh3_64_intdigest(core, (anchor * 31 + j) & LAST) - (1 << 63)
                    out.append((group, xxhash.xxh3_64_intdigest(part, at - x) - (1 << 63), i, t, lo + x, part))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=names)

    return slices.mapInArrow(tidied(run), "anchor long, kind long, id long, t binary, lo int, body binary")


def _hot_spans(scope: Scope, slices: DataFrame, length: int, least: int, keep: str, hot: int) -> DataFrame:
    """Spans of one length from slices of hot groups."""
    blocks = scope.written(_blocks(slices, length, least), "blocks")
    place = F.struct("t", "lo")
    kinds = blocks.groupBy("anchor", "kind").agg(F.min(F.struct("id", "t", "lo", "body")).alias("first"), F.min(place).alias("x"), F.max(place).alias("y"))
    kinds = scope.written(kinds.select("anchor", "kind", "first", (F.col("x") != F.col("y")).alias("twice")), "kinds")
    whole = blocks.join(kinds.where("twice").select("anchor", "kind", F.struct("first.t", "first.lo").alias("first")), ["anchor", "kind"])
    if keep == "first":
        whole = whole.where("t <> first.t or lo <> first.lo")
    spans = whole.select("t", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("body")).alias("b"), F.lit(length).alias("length"))
    several = scope.written(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    places = (F.octet_length("first.body") - (length - 1)).alias("n")
    again = scope.written(kinds.join(several.withColumnRenamed("n", "kinds"), "anchor").select("anchor", "first.id", "first.t", "first.lo", places, "first.body", (F.col("kinds") > hot).alias("hot")), "slices")
    dealt = again.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    return spans.unionByName(_compared(dealt, (length,), keep)).unionByName(_strings(again.where("hot").drop("hot"), length, keep))


def _strings(slices: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans from slices of hot groups: every string by its own hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, i, t, lo, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [xxhash.xxh3_128_intdigest(body[k : k + length]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([(d >> 64) - (1 << 63) for d in digests], pa.int64()), pa.array([(d & ((1 << 64) - 1)) - (1 << 63) for d in digests], pa.int64()), pa.array([i] * n, pa.int64()), pa.array([t] * n, pa.binary()), pa.array(range(lo, lo + n), pa.int32())], names=["w1", "w2", "id", "t", "a"])

    every = slices.mapInArrow(tidied(run), "w1 long, w2 long, id long, t binary, a int")
    place = F.struct("t", "a")
    twice = every.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min(F.struct("id", "t", "a")).alias("first")).where("lo <> hi").select("w1", "w2", "first")
    out = every.join(twice, ["w1", "w2"])
    if keep == "first":
        out = out.where("t <> first.t or a <> first.a")
    return out.select("t", "a", (F.col("a") + length).alias("b"), F.lit(length).alias("length"))


def _repeated(scope: Scope, rows: DataFrame, lengths: tuple[int, ...], keep: str, hot: int) -> DataFrame:
    """(t, spans): for each distinct text with repeats, byte ranges to remove for each length, unmerged; repeats of a kind inside one text are left to :func:`local_spans`, and may be all that a text with no spans has."""
    least, most = min(lengths), max(lengths)
    segments = _segments(rows, least, most)
    # written, and merged: the rows of a frequent anchor can then be split over tasks
    often = scope.written(segments.groupBy("anchor").agg(F.min("p").alias("p"), F.max("q").alias("q")).where("p <> q").select("anchor"), "often")
    segments = scope.written(segments.hint("merge").join(often, "anchor"), "segments")
    scope.drop(often)
    kinds = segments.groupBy("anchor", "kind").agg(F.min(F.struct("id", "t", "lo", "hi", "end")).alias("first"), F.min("p").alias("p"), F.max("q").alias("q"))
    kinds = scope.written(kinds.select("anchor", "kind", "first", (F.col("p") != F.col("q")).alias("twice")), "kinds")
    whole = segments.join(kinds.where("twice").select("anchor", "kind", "first"), ["anchor", "kind"])
    if keep == "first":
        whole = whole.where("t <> first.t or lo <> first.lo")
    none = F.lit(None).cast("int")
    for i, length in enumerate(lengths):
        each = whole.select("t", F.col("lo").alias("a"), F.least(F.col("hi") + length, "end").alias("b"), F.lit(length).alias("length")).where(F.col("b") - F.col("a") >= length)
        spans = spans.unionByName(each) if i else each
    if keep == "first":
        # the first place of a kind is no span, though others may follow it in its text
        spans = spans.unionByName(segments.where("p <> q").select("t", none.alias("a"), none.alias("b"), F.lit(least).alias("length")))
    spans = spans.distinct()
    several = scope.written(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    wanted = kinds.join(several, "anchor").select("first.id", "first.t", F.struct("anchor", "first.lo", "first.hi", "first.end", (F.col("n") > hot).alias("hot")).alias("seg"))
    slices = scope.written(_sliced(wanted.groupBy("id", "t").agg(F.collect_list("seg").alias("segs")), _packed(rows)), "slices")
    dealt = slices.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.unionByName(_compared(dealt, lengths, keep))
    for length in lengths:
        spans = spans.unionByName(_hot_spans(scope, slices.where("hot").drop("hot"), length, least, keep, hot))
    return spans.groupBy("t").agg(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b", "length"))).alias("spans"))


def local_spans(body: bytes, lengths: tuple[int, ...], keep: str) -> list[tuple[int, int, int]]:
    """Ranges, with their length, of kinds that occur several times in one text; the first occurrence is not among them if it is to be kept."""
    data = np.frombuffer(body, np.uint8)
    lo, hi, anchor, code = anchors(data, np.array([0, len(data)]), min(lengths))
    end = np.minimum(hi + max(lengths), len(data))
    seen: dict[tuple[int, int], list[int]] = {}
    for i, (x, y, z, p, c) in enumerate(zip(lo.tolist(), hi.tolist(), end.tolist(), anchor.tolist(), code.tolist())):
        seen.setdefault((c, xxhash.xxh3_64_intdigest(body[x:z], (p - x) << 20 | (y - x))), []).append(i)
    out = []
    for places in seen.values():
        if len(places) > 1:
            for i in places[keep == "first" :]:
                for length in lengths:
                    a, b = int(lo[i]), min(int(hi[i]) + length, int(end[i]))
                    if b - a >= length:
                        out.append((a, b, length))
    return out


def union(spans: list[tuple[int, int, int]], length: int) -> list[tuple[int, int]]:
    """The spans of one length, merged."""
    spans = [s for s in spans if s[2] == length]
    a, b = merged(np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64))
    return list(zip(a.tolist(), b.tolist()))


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def _plans(scope: Scope, rows: DataFrame, lengths: tuple[int, ...], keep: str, hot: int) -> DataFrame:
    """(t, first_id, copied, spans) of each distinct text with repeats or with copies of at least the least length, written."""
    spans = _repeated(scope, rows, lengths, keep, hot)
    firsts = rows.groupBy("t").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max(F.octet_length("body")).alias("size"))
    copied = (F.col("n") > 1) & (F.col("size") >= min(lengths))
    plan = firsts.join(spans, "t", "left").where(F.col("spans").isNotNull() | copied)
    out = scope.written(plan.select("t", "first_id", "size", copied.alias("copied"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int,length:int>>")).alias("spans")), "plan")
    scope.drop(*(scope.paths - {out._path}))
    return out


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400, least: int = 240, hot: int = 512) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated for every row, all repeats removed.

    n_removed, n_spans and kept_sha256 are those of strings of ``length``
    bytes; n_repeated is the number of bytes that strings of ``least`` bytes
    cover which also start elsewhere.  A null text is empty.  Texts shorter
    than a length keep all.  Rows with equal texts of at least that many bytes
    lose all.  Ids are integers or null.
    """
    scope, lengths = Scope(docs.sparkSession), (length, least)
    rows = _rows(docs, key, text)
    plan = _plans(scope, rows, lengths, "none", hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for t, found, z in zip(*(c.to_pylist() for c in batch.columns)):
                body = unpack(z)
                spans = [(s["a"], s["b"], s["length"]) for s in found] + local_spans(body, lengths, "none")
                gone, again = union(spans, length), union(spans, least)
                out.append((t, sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(body, gone)).hexdigest(), sum(b - a for a, b in again)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["t", "removed", "spans", "kept", "repeated"])

    alone = plan.where("not copied").select("t", F.col("first_id").alias("id"), "spans")
    cut = alone.join(_packed(rows), ["id", "t"]).select("t", "spans", "packed").mapInArrow(tidied(run), "t binary, removed long, spans long, kept string, repeated long")
    size = F.col("size").cast("long")
    whole = plan.where("copied").select("t", F.when(size >= length, size).otherwise(0).alias("removed"), F.when(size >= length, 1).otherwise(0).cast("long").alias("spans"), F.when(size >= length, F.sha2(F.lit(""), 256)).alias("kept"), size.alias("repeated"))
    # the only shuffle of rows by text, between two plain exchanges: a text that many rows share can be split
    found = scope.written(cut.unionByName(whole), "cut")
    scope.drop(plan)
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(key, F.unhex(F.md5(body.cast("binary"))).alias("t"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    none = F.lit(0).cast("long")
    out = plain.join(found, "t", "left").select(key, "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("repeated", none).alias("n_repeated"))
    return scope.owned(out, found)


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 400, over_words: int = 0, always: int = 400, hot: int = 512) -> DataFrame:
    """``docs`` with later occurrences removed from ``text``; the first, by id and place, stays.

    With ``over_words`` a removed span must have more words than that, or
    ``always`` bytes.  A span shrinks to whole characters.  Of rows with one
    text the first keeps it; later ones, and later copies within it, lose all
    that repeats; rows that share both id and text count as the first alike.
    A null text stays null.  All other columns stay as they are.  Ids are
    integers or null.
    """
    scope = Scope(docs.sparkSession)
    plan = _plans(scope, _rows(docs, key, text), (length,), "first", hot)
    wanted = plan.select(F.col("t").alias("__pt"), "first_id", F.col("spans").alias("__spans"))
    names = docs.columns
    at = names.index(text)
    # texts are compressed for the shuffle
    packed_schema = docs.withColumn(text, F.lit(b"")).withColumn("__t", F.lit(b"")).schema
    packed_schema[at].nullable = True

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstd.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([None if x is None else compress(x.encode()) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=[*names, "__t"])

    wide = docs.withColumn("__t", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))).mapInArrow(tidied(pack), packed_schema).join(wanted, F.col("__t") == F.col("__pt"), "left")
    wide = wide.withColumn("__mode", F.when(F.col("__pt").isNull(), 0).when(F.coalesce(F.col(key).cast("long"), F.lit(LAST)) == F.col("first_id"), 1).otherwise(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            texts = [None if x is None else unpack(x).decode() for x in batch.column(at).to_pylist()]
            for i, (mode, found) in enumerate(zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names)).to_pylist())):
                if not mode or texts[i] is None:
                    continue
                body = texts[i].encode()
                spans = union([(s["a"], s["b"], s["length"]) for s in found] + local_spans(body, (length,), "first"), length) if mode == 1 else [(0, len(body))] if len(body) >= length else []
                spans = [(a, b) for a, b in spans if b - a >= always or len(body[a:b].split()) > over_words]
                texts[i] = without(body, _whole_characters(body, spans)).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(names)]], names=names)

    out = wide.select(*names, "__spans", "__mode").mapInArrow(tidied(run), docs.schema)
    return scope.owned(out, plan)


def _whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends."""
    out = []
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out
