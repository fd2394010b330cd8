"""From raw documents to a training sample, in five stages.

Each stage reads all that the one before kept, and its decisions take effect:

1. quality rules: rejected documents go;
2. n-gram Jaccard join: of each group of near copies the least id stays;
3. suffix-array dedup: byte strings that occurred before are cut out of the
   texts if they have over ``WORDS`` words or 400 bytes; the first occurrence
   stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing: documents are sampled so that weighted tokens meet the targets.

Stages 1 to 4 return the columns of their input; 5 adds mix_topic and
mix_weight, or replaces columns of these names.  Every stage takes nulls in any
column, empty and long texts, repeated rows and extra columns as its operator
says: a null text is rejected by the first stage, as it has no words.  Empty
input gives empty output.  n_chars is that of the original.

:func:`run` deletes the tables behind a stage's result once that is written.
Whoever calls the stages one by one is to write each result before the next
stage begins, which then deletes what the last one begun in its thread left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import local

from pyspark.sql import DataFrame, SparkSession

from textsentry._ship import ship
from textsentry.llm import decontaminate, mixing, ngram_join, quality_rules, suffix_dedup
from textsentry.llm._run import Scope, opened, table

#: Passages of over so many words are cut; they are searched by ``REPEAT`` bytes, three to a word.
WORDS, REPEAT = 50, 160

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By thread: scopes of the stage begun last.
_last = local()


def _closed() -> None:
    for scope in getattr(_last, "scopes", []):
        scope.close()
    _last.scopes = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        _closed()
        with opened() as scopes:
            _last.scopes = scopes
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept_firsts(docs)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs, length=REPEAT, over_words=WORDS)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("suffix_dedup", repeats),
    ("decontaminate", decontaminated),
    ("mixing", mixture),
]

#: The stages' estimates and searches go beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    own, docs = Scope(spark), table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs, before = own.written(f(spark, docs, sf_dir), name), docs
        _closed()
        own.drop(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    # what is behind the result belongs to it, no more to the thread
    own.paths |= {path for scope in _last.scopes for path in scope.paths}
    _last.scopes = []
    out._scope = own
    return out
