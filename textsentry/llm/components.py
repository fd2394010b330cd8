"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import Scope


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: neighbours of each node move to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("node"), "m")
    joined = both.join(least, F.col("u") == F.col("node"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60, scope: Scope | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that can be reached.

    Nothing is collected but a count and a checksum per round; each round is
    written to the shared folder.  A node with very many edges is one row of
    a partial aggregation and a join key that adaptive execution may split.
    Tables go to ``scope``, or to one of the result's own.
    """
    own = scope or Scope(edges.sparkSession)
    now = own.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now, before = own.written(_starred(_starred(now, True), False), "edges"), now
        own.drop(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._path = now._path
    return out if scope else own.owned(out, now)
