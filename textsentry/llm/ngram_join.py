"""Exact self-join on the Jaccard similarity of word-shingle sets.

Two texts link when their sets of distinct n-word shingles share at least
``percent`` in a hundred of their union.

* Equal sets are one class; only its least id takes part in the join.
* Shingles are put in one order, rare first by a sketch of their document
  counts.  Linked sets share a shingle of their prefixes, and the lengths and
  the shingle's places in them bound the overlap: prefix, length and
  positional filter.
* A prefix shingle's group is never paired all with all.  Up to ``small``
  members it is; a larger one is compared to a few members drawn as leaders,
  components are formed, and only members that stand in different components
  are compared to ever more leaders (four, then eight times as many), until
  no group holds two components with a pair left to compare.  Members whose
  length and place rule out all others of their group leave it first, so that
  a template which many texts share without linking is not gone through pair
  by pair.  Components are exact: a pair is skipped only if already joined or
  ruled out.
* Each pair is verified once, on the whole sets; a suffix filter ends hopeless
  comparisons early.

Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsentry.llm._run import Scope, tidied, unit_hash
from textsentry.llm._text import sets_of
from textsentry.llm.components import components

SKETCH_BITS = 18
_SLAB = 4096


def document_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Document counts of all shingles, summed by the top ``SKETCH_BITS`` of their hashes: a table of fixed size."""
    slabs = (1 << SKETCH_BITS) // _SLAB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for grams in sets_of(batch.column(0), words):
                np.add.at(total, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            part = int(total.sum()) % 16
            pack = zstd.ZstdCompressor().compress
            yield pa.RecordBatch.from_arrays([pa.array(range(slabs), pa.int32()), pa.array([part] * slabs, pa.int32()), pa.array([pack(total[i * _SLAB : (i + 1) * _SLAB].tobytes()) for i in range(slabs)], pa.binary())], names=["slab", "part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(_SLAB, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(zstd.decompress(x.as_py()), np.int64)
        return pa.table({"slab": rows.column("slab").slice(0, 1), "part": rows.column("part").slice(0, 1), "counts": pa.array([zstd.compress(total.tobytes())], pa.binary())})

    schema = "slab int, part int, counts binary"
    found = docs.select(text).mapInArrow(tidied(count), schema).groupBy("slab", "part").applyInArrow(add, schema).groupBy("slab").applyInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in found.collect():
        out[r["slab"] * _SLAB : (r["slab"] + 1) * _SLAB] = np.frombuffer(zstd.decompress(r["counts"]), np.int64)
    return out


def _prefixes(docs: DataFrame, key: str, text: str, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """id, s1 and s2 (hash of the set), n (its size), prefix (rare first), and for each of it whether it is frequent."""
    hot = max(2048, 4 * int(counts.mean()))
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, size, prefix, often, at = [], [], [], [], [], [0]
            for grams in sets_of(batch.column(1), words):
                digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                s1.append((digest >> 64) - (1 << 63))
                s2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                n = len(grams)
                size.append(n)
                seen = counts[(grams >> shift).astype(np.int64)]
                first = np.argsort(seen, kind="stable")[: n - -(-percent * n // 100) + 1 if n else 0]
                prefix.append(grams[first].view(np.int64))
                often.append(seen[first] > hot)
                at.append(at[-1] + len(first))
            border = pa.array(at, pa.int32())
            arrays = [pa.ListArray.from_arrays(border, pa.array(np.concatenate(x), kind)) for x, kind in ((prefix, pa.int64()), (often, pa.bool_()))] if size else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int64()), *arrays], names=["id", "s1", "s2", "n", "prefix", "often"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(tidied(run), "id long, s1 long, s2 long, n long, prefix array<long>, often array<boolean>")


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, packed): texts, compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())], names=["doc", "packed"])

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(tidied(run), "doc long, packed binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets share ``percent`` in a hundred of their union; no empty set links."""
    if not len(a) or not len(b):
        return False
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    # suffix filter: cut both at quarter points of the first; parts share no more than the smaller one has
    cuts = a[[len(a) // 4, len(a) // 2, 3 * len(a) // 4]]
    x, y = (np.diff(np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))) for s in (a, b))
    if int(np.minimum(x, y).sum()) < need:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = int(np.count_nonzero(b[at] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

        def of(doc: int, packed: bytes) -> np.ndarray:
            which = doc, hash(packed)
            if which not in kept:
                kept[which] = next(sets_of(pa.array([unpack(packed).decode()], pa.string()), words))
                if len(kept) > 64:
                    kept.popitem(last=False)
            kept.move_to_end(which)
            return kept[which]

        for batch in batches:
            a, b, x, y = batch.columns
            yes = [linked(of(i.as_py(), p.as_py()), of(j.as_py(), q.as_py()), percent) for i, j, p, q in zip(a, b, x, y)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(yes, pa.bool_())], names=["a", "b", "linked"])

    one = texts.select(F.col("doc").alias("a"), F.col("packed").alias("x"))
    two = texts.select(F.col("doc").alias("b"), F.col("packed").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long, linked boolean")


def _candidates(entries: DataFrame, leaders: int, small: int, percent: int, seed: int) -> DataFrame:
    """Distinct pairs (a < b) of group members and their group's leaders which stand in different components and pass the filters."""
    rate = F.when(F.col("members") <= small, 1.0).otherwise(leaders / F.col("members"))
    lead = entries.where(unit_hash(F.col("id"), seed=seed) < rate).select("g", F.col("id").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("lead_pos"), F.col("label").alias("lead_label"))
    # merged, not broadcast: the rows of a frequent shingle can then be split over tasks
    both = entries.hint("merge").join(lead, "g").where("id <> lead and label <> lead_label")
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & ((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("lead_pos")) >= percent * (F.col("n") + F.col("m")))
    return both.where(fits).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _able(entries: DataFrame, percent: int) -> DataFrame:
    """``entries`` of groups that stand in different components, without members that can link with none of their group.

    A member's place bounds the size of those it links with from above, its
    size from below.  What is left over is looked at a second time.
    """
    reach = F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")
    for _ in range(2):
        entries = entries.withColumns({"__reach": F.least(reach, F.floor(100 * F.col("n") / percent)), "__least": F.ceil(percent * F.col("n") / 100)})
        group = entries.groupBy("g").agg(F.min("label").alias("__lo"), F.max("label").alias("__hi"), F.min("n").alias("__min"), F.max("n").alias("__max"), F.max("__reach").alias("__far"))
        entries = entries.hint("merge").join(group.where("__lo < __hi").drop("__lo", "__hi"), "g").where("__min <= __reach and __max >= __least and __far >= n")
        entries = entries.drop("__reach", "__least", "__min", "__max", "__far")
    return entries


def _labelled(entries: DataFrame, found: DataFrame) -> DataFrame:
    return entries.drop("label").join(found, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, small: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, and class_id, the least id with the same set.

    Null and empty texts and texts without words have no shingles and link
    with nothing: their component and class are their own id.  A text of fewer
    than ``words`` words has one shingle.  Ids are integers.  Rows that repeat
    an id are one document with several texts: it links with what any of them
    links with.  A row without an id gets the component of its set if another
    row has that, else null.
    """
    scope = Scope(docs.sparkSession)
    rows = scope.written(_prefixes(docs, key, text, words, percent, document_counts(docs, text, words)), "sets")
    members = scope.written(rows.select("id", "s1", "s2", "n"), "members")
    named = rows.where("n > 0 and id is not null")
    classes = scope.written(named.groupBy("s1", "s2").agg(F.min("id").alias("class_id")), "classes")
    firsts = named.groupBy("s1", "s2").agg(F.min_by(F.struct("id", "n", "prefix", "often"), "id").alias("r")).select("r.*")
    # size and place in one number: this is the largest shuffle
    every = firsts.select("id", "n", F.posexplode(F.arrays_zip("prefix", "often")).alias("pos", "e")).select(F.col("e.prefix").alias("g"), "id", (F.col("n") * (1 << 32) + F.col("pos")).alias("np"), F.col("e.often").alias("often"))
    # a frequent shingle surely has several members; its group is not brought together to count them
    rare = every.where("not often").drop("often").withColumn("c", F.count("*").over(Window.partitionBy("g"))).where("c > 1").drop("c")
    entries = rare.unionByName(every.where("often").drop("often"))
    found_twice = scope.written(entries.select("g", "id", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND((1 << 32) - 1).alias("pos")), "entries")
    scope.drop(rows)
    sizes = scope.written(found_twice.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    entries = scope.written(found_twice.hint("merge").join(sizes, "g").withColumn("label", F.col("id")), "entries")
    scope.drop(found_twice, sizes)
    texts = scope.written(_packed(docs, key, text).dropna(subset=["doc"]).join(entries.select(F.col("id").alias("doc")).distinct(), "doc", "left_semi").dropDuplicates(["doc", "packed"]), "texts")
    # texts of one id are one document: the classes of its texts are joined
    classed = members.where("n > 0 and id is not null").join(classes, ["s1", "s2"]).groupBy("id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.collect_set("class_id").alias("all"))
    edges = classed.where("a < b").select("a", F.explode("all").alias("b")).where("a < b")
    leaders, largest = 4, entries.agg(F.max("members")).first()[0] or 0
    open_groups, tested, found, done = entries, None, None, []
    while True:
        pairs = _candidates(open_groups, leaders, small, percent, seed=leaders)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done.append(scope.written(_verified(pairs, texts, words, percent), "pairs"))
        tested = done[-1].select("a", "b") if tested is None else tested.unionByName(done[-1].select("a", "b"))
        edges = edges.unionByName(done[-1].where("linked").select("a", "b"))
        found, before = components(edges, scope=scope), found
        scope.drop(before)
        if largest <= max(small, leaders):
            break
        large = _labelled(open_groups.where(F.col("members") > max(small, leaders)), found)
        open_groups, before = scope.written(_able(large, percent), "entries"), open_groups
        scope.drop(before)
        largest = open_groups.agg(F.max("members")).first()[0] or 0
        if not largest:
            break
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        leaders *= 8
    scope.drop(open_groups, texts, *done)
    named = classes.join(found, F.col("class_id") == F.col("node"), "left").select("s1", "s2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = members.where("n > 0").join(named, ["s1", "s2"], "left").select("id", "n", "component_id", "class_id")
    out = out.unionByName(members.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.col("id").alias("class_id")))
    return scope.owned(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "class_id"), members, classes, found)


def kept_firsts(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows that share the least id stay, as do rows without an id."""
    key = str(options.get("key", "doc_id"))
    found = similar(docs, **options)
    drop = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("__drop")).distinct()
    out = docs.join(drop, F.col(key) == F.col("__drop"), "left_anti")
    out._scope = found._scope
    return out
