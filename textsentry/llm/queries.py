"""The registered queries of the ten operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry._ship import ship
from textsentry.llm import decontaminate, kneser_ney, langid, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, toxicity, url_rules
from textsentry.llm._run import Scope, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    texts, classes = quality_classifier.labelled_sample(docs, labels, "quality")
    model = quality_classifier.train(texts, np.array(classes, np.int64))
    return quality_classifier.scored(docs, model, keep=("doc_id", held_out.alias("held_out")))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op3_suffix_dedup"] = """
WITH p AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS k FROM p WHERE length(x) >= 800),
m AS (SELECT doc_id, k, md5(substr(x, 2 * k + 1, 800)) AS f FROM w),
d AS (SELECT doc_id, k FROM m SEMI JOIN (SELECT f FROM m GROUP BY f HAVING count(*) > 1) USING (f)),
i AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 400 THEN 0 ELSE 1 END AS fresh FROM d),
g AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM i),
s AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
again AS (SELECT doc_id, md5(substr(x, 2 * k + 1, 480)) AS f, k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 239)) AS k FROM p WHERE length(x) >= 480)),
c AS (SELECT doc_id, sum(least(240, after - k)) AS repeated FROM (SELECT doc_id, k, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k), k + 240) AS after FROM again SEMI JOIN (SELECT f FROM again GROUP BY f HAVING count(*) > 1) USING (f)) GROUP BY doc_id),
u AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM t JOIN p USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeated FROM p LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select(F.col("__row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "weight", "probability", "kept", "mix_weight")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    tox = toxicity.fit(docs.where(~held_out), labels, "toxic")
    return toxicity.scored(docs, tox, keep=("doc_id", held_out.alias("held_out")))


ORACLE_SQL["op6_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, s FROM s),
g AS (SELECT doc_id, n, unnest(s) AS g FROM c WHERE doc_id = class_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT a, a FROM both_ways UNION SELECT r.doc_id, x.b FROM r JOIN both_ways x ON r.reached = x.a),
m AS (SELECT doc_id, min(reached) AS component FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(m.component, c.class_id) AS component_id, c.class_id FROM c LEFT JOIN m ON c.class_id = m.doc_id
"""


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


@query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.scored(docs, model, keep=("doc_id", held_out.alias("held_out"))).drop("perplexity")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.fit_dictionaries(docs.where(~held_out))
    return langid.identify(docs, model, keep=("doc_id", held_out.alias("held_out")))


#: Fixed by the contract of the query: verdict, host, start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels")
    # a page shows the document whose number its path carries
    number = F.regexp_extract(url_rules.path_of(F.col("url")), "^/[^/]+/([0-9]{1,18})", 1)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    shown = pages.select("url", number.try_cast("bigint").alias("doc_id")).join(labels, "doc_id").select("url", bad.alias("bad"))
    mined = url_rules.mine(shown)
    out = url_rules.judge(pages, URL_RULES, mined)
    # what the rules were chosen from, as there may be none
    return out.withColumns({"rules_mined": F.lit(len(mined.rules)), "rules_looked_at": F.lit(mined.looked_at), "bad_share": F.lit(float(mined.bad_share)), "best_confidence": F.lit(float(mined.best_confidence))})


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = Scope(spark)
    measures = scope.written(quality_rules.measured(table(spark, sf_dir, "documents")), "quality")
    out = quality_rules.judged(measures)
    return scope.owned(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"), measures)
