"""Mixing to target shares: iterative proportional fitting, then calibrated sampling.

Tokens are counted by cell (source, language, topic).  Raking scales the
cells until the weighted tokens meet the target shares of every margin.  A
document is then kept with the probability min(1, c * weight of its cell),
with c such that the expected tokens are ``keep_share`` of all; what a capped
cell lacks is carried by ``mix_weight`` = weight / probability, so weighted
sums meet the targets without bias.

Targets are shares by value for each margin, given or, where none are,
proportional to a power of the margin's tokens.  The cells are raked on the
driver while they are few and as a table beyond; both take the same steps to
the same tolerance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsentry.llm._run import Scope, unit_hash

#: Topics by signs in the text; the first that fits, else "prose".
TOPICS = {"licence": ["License", "license", "rights reserved"], "contact": ["@"], "table": [" | "]}
DIMS = ("source", "lang", "topic")
#: Shares by value for some of ``DIMS``; None stands for rows without a value.
Targets = dict[str, dict[str | None, float]]
#: Without targets, a margin's share is proportional to its tokens to this power.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def topic_of(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """Null texts are prose."""
    out = F.lit("prose")
    for name, signs in reversed((topics or TOPICS).items()):
        has = F.lit(False)
        for s in signs:
            has = has | text.contains(s)
        out = F.when(has, name).otherwise(out)
    return out


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def tempered(tokens: dict, power: float) -> dict:
    total = sum(n**power for n in tokens.values() if n)
    return {k: n**power / total if n else 0.0 for k, n in tokens.items()} if total else {k: 0.0 for k in tokens}


def aimed(tokens: dict, power: float, target: dict | None = None) -> dict:
    """Shares of a margin's values: those of ``target`` that have tokens, made to sum to one, or else tempered ones."""
    if target is None:
        return tempered(tokens, power)
    own = {k: max(0.0, float(target.get(k, 0.0))) if n else 0.0 for k, n in tokens.items()}
    total = sum(own.values())
    return {k: x / total for k, x in own.items()} if total else own


def rake(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], *, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of cells (codes per dimension) under which the weighted tokens have the target shares.

    A value whose target is zero loses all weight; margins without tokens keep
    theirs, as does a margin all of whose targets are zero.  If targets
    contradict each other over the cells there are, the last round's weights
    are returned: the last dimension is met, the others as near as raking gets.
    """
    weight, total = np.ones(len(tokens)), tokens.sum()
    for _ in range(rounds if total else 0):
        worst = 0.0
        for codes, target in zip(cells, targets):
            now = np.bincount(codes, tokens * weight, len(target))
            factor = np.where((now > 0) & bool(target.sum()), target * total / np.where(now > 0, now, 1), 1.0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            weight = weight * factor[codes]
        if worst < tolerance:
            break
    return weight


def calibrate(sums: Callable[[float], tuple[float, float]], total: float, most: float, keep_share: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = keep_share * total.

    ``sums`` gives the tokens of the cells that c fills, and the weighted
    tokens of the others.  The kept tokens grow with c along a line that bends
    down where a cell is full: Newton's steps from the left end at the root.
    ``most`` fills all cells.
    """
    c = 0.0
    while total:
        capped, slope = sums(c)
        new = min((keep_share * total - capped) / slope, most) if slope else most
        if new <= c * (1 + 1e-14):
            break
        c = new
    return c


def _rake_near(cells: DataFrame, powers: dict[str, float], keep_share: float, targets: Targets) -> DataFrame:
    rows = sorted(tuple(r) for r in cells.select(*DIMS, "tokens").collect())
    tokens = np.array([r[3] for r in rows], np.float64)
    codes, shares = [], []
    for i, d in enumerate(DIMS):
        values = sorted({r[i] for r in rows})
        place = {x: k for k, x in enumerate(values)}
        codes.append(np.array([place[r[i]] for r in rows], np.int64))
        share = aimed(dict(zip(values, np.bincount(codes[-1], tokens, len(values)).tolist())), powers[d], _coded(targets.get(d)))
        shares.append(np.array([share[v] for v in values]))
    weight = rake(codes, tokens, shares)

    def sums(c: float) -> tuple[float, float]:
        full = c * weight >= 1
        return float(tokens[full].sum()), float((tokens * weight)[~full].sum())

    c = calibrate(sums, float(tokens.sum()), 1 / weight[weight > 0].min() if (weight > 0).any() else 1.0, keep_share)
    schema = T.StructType([*(T.StructField(d, T.StringType()) for d in DIMS), T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    return cells.sparkSession.createDataFrame([(*r[:3], float(w), min(1.0, float(c * w))) for r, w in zip(rows, weight)], schema)


def _rake_far(scope: Scope, cells: DataFrame, powers: dict[str, float], keep_share: float, targets: Targets, *, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """The same where the cells are too many for the driver: margins are joined, each round is written; only sums and maxima are collected."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {}
    for d in DIMS:
        margin = cells.groupBy(F.col(d).alias("m")).agg(F.sum("tokens").alias("n"))
        if (given := _coded(targets.get(d))) is None:
            margin = margin.withColumn("p", F.when(F.col("n") > 0, F.pow("n", F.lit(powers[d]))).otherwise(0.0))
        else:
            table = cells.sparkSession.createDataFrame([(k, max(0.0, float(x))) for k, x in given.items()], "v string, x double")
            margin = margin.join(table, F.col("m") == F.col("v"), "left").withColumn("p", F.when(F.col("n") > 0, F.coalesce("x", F.lit(0.0))).otherwise(0.0))
        whole = margin.agg(F.sum("p")).first()[0] or 0.0
        wanted[d] = scope.written(margin.select("m", (F.col("p") / whole * total if whole else F.lit(None).cast("double")).alias("want")), "targets")
    old = None
    cells = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds if total else 0):
        cells = cells.withColumn("off", F.lit(0.0))
        for d in DIMS:
            now = cells.groupBy(F.col(d).alias("m")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(wanted[d], "m").select("m", F.when(F.col("now") > 0, F.coalesce(F.col("want") / F.col("now"), F.lit(1.0))).otherwise(1.0).alias("f"))
            cells = cells.join(now, F.col(d) == F.col("m")).withColumn("weight", F.col("weight") * F.col("f")).withColumn("off", F.greatest("off", F.abs(F.col("f") - 1))).drop("m", "f")
        new = scope.written(cells, "cells")
        scope.drop(old)
        old, cells = new, new.drop("off")
        if new.agg(F.max("off")).first()[0] < tolerance:
            break
    scope.drop(*wanted.values())
    least = cells.where("weight > 0").agg(F.min("weight")).first()[0] or 1.0

    def sums(c: float) -> tuple[float, float]:
        full = c * F.col("weight") >= 1
        capped, slope = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        return float(capped), float(slope)

    c = calibrate(sums, total, 1 / least, keep_share)
    return cells.select(*DIMS, "weight", F.least(F.lit(1.0), c * F.col("weight")).alias("probability"))


def _code(value: Column) -> Column:
    """A text for each value that differs from that of null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _coded(target: dict[str | None, float] | None) -> dict[str, float] | None:
    return None if target is None else {"" if k is None else f"={k}": x for k, x in target.items()}


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | Column | None = None, targets: Targets | None = None, powers: dict[str, float] | None = None, keep_share: float = 0.5, near_cells: int = 50_000, seed: int = 4) -> DataFrame:
    """``__row`` (all columns of ``docs``), source, lang, topic, n_tokens, weight, probability, kept and mix_weight.

    ``topic`` names a column or is an expression over the columns of ``docs``,
    else :func:`topic_of` the text.  A null source, language or topic is a
    value of its own.  Equal rows are kept or not together.  Up to
    ``near_cells`` cells (counted first) are raked on the driver and
    broadcast; more stay a table.  Texts without words weigh nothing in the
    targets but are sampled like their cell; cells of weight zero are not kept
    and have no mix_weight.
    """
    scope = Scope(docs.sparkSession)
    powers, targets = powers or POWERS, targets or {}
    body = F.coalesce(F.col(text), F.lit(""))
    about = topic_of(body) if topic is None else F.col(topic) if isinstance(topic, str) else topic
    wide = docs.select(F.struct("*").alias("__row"), _code(F.col(source)).alias("source"), _code(F.col(lang)).alias("lang"), _code(about).alias("topic"), words_in(body).alias("n_tokens"), unit_hash(F.col(key).cast("string"), F.xxhash64(body), seed=seed).alias("__u"))
    cells = scope.written(wide.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() <= near_cells:
        out = wide.join(F.broadcast(_rake_near(cells, powers, keep_share, targets)), list(DIMS))
        behind: list[DataFrame] = []
    else:
        # merged: one cell may hold a third of the rows, and is then split over tasks
        factors = scope.written(_rake_far(scope, cells, powers, keep_share, targets), "factors")
        out, behind = wide.hint("merge").join(factors, list(DIMS)), [factors]
    back = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c)
    ratio = F.when(F.col("probability") > 0, F.col("weight") / F.col("probability")).alias("mix_weight")
    return scope.owned(out.select("__row", back("source"), back("lang"), back("topic"), "n_tokens", "weight", "probability", (F.col("__u") < F.col("probability")).alias("kept"), ratio), *behind)


def sampled(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that are kept, with ``mix_topic`` and ``mix_weight``, which replace columns of these names.

    Nulls, empty texts, repeated rows and empty tables: see :func:`mixed`.
    """
    found = mixed(docs, **options)
    names = [f"__row.`{c}`" for c in docs.columns if c.lower() not in ("mix_topic", "mix_weight")]
    out = found.where("kept").select(*names, F.col("topic").alias("mix_topic"), "mix_weight")
    out._scope = found._scope
    return out
