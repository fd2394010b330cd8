"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textsentry.llm import decontaminate, kneser_ney, langid, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, toxicity, url_rules


def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (None, "one two")], "item_id long, text string")


def one(df):
    texts, classes = quality_classifier.labelled_sample(df, df.select("doc_id", F.lit(1).alias("quality")), "quality")
    return quality_classifier.scored(df, quality_classifier.train(texts, np.array(classes, np.int64), epochs=1))


def five(df):
    texts, toxic = quality_classifier.labelled_sample(df, df.select("doc_id", F.lit(0).alias("toxic")), "toxic")
    return toxicity.scored(df, toxicity.train(texts, toxic), restored=True)


PER_ROW = {
    "quality_classifier": one,
    "suffix_dedup": suffix_dedup.digests,
    "cut_repeats": suffix_dedup.cut_repeats,
    "mixing": mixing.mixed,
    "toxicity": five,
    "ngram_join": ngram_join.similar,
    "kneser_ney": lambda df: kneser_ney.scored(df, kneser_ney.fit(df)),
    "langid": lambda df: langid.identify(df, langid.fit_dictionaries(df)),
    "quality_rules": lambda df: quality_rules.judged(quality_rules.measured(df)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, edges, nothing):
    assert PER_ROW[name](edges).count() == edges.count()
    assert PER_ROW[name](nothing).count() == 0


def test_defined_results(edges):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(edges).collect()}
    assert {(1, 116, 1), (2, 116, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (9, 1, 9), (None, 0, None)} <= got
    cut = suffix_dedup.digests(edges).collect()
    by = {r.doc_id: r for r in cut if r.doc_id}
    assert by[1].n_removed == by[1].n_bytes == by[2].n_removed > 400
    assert by[6].n_removed == 0 and by[3].n_bytes == 0
    assert by[7].n_removed == by[7].n_bytes
    kept = suffix_dedup.cut_repeats(edges)
    assert kept.columns == edges.columns
    rows = {(r.doc_id, r.text is None): r for r in kept.collect()}
    assert rows[(3, True)].text is None
    assert rows[(2, False)].text == "" and len(rows[(1, False)].text) > 400


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (3, "no scheme", "x"), (None, "http://A.Net?x", "x"), (5, "http://a.net/", "x"), (6, "x://" + "h" * 100_000 + "/" + "p/" * 50_000, "x")], "page_id long, url string, host string")
    bad = spark.createDataFrame([("http://a.b/c", None), (None, True), ("", True), ("x", False)], "url string, bad boolean")
    rules = [("block", "net", "/")]
    got = sorted((r.page_id or 0, r.host[:9], r.path[:3], r.rule, r.verdict) for r in url_rules.judge(pages, rules, url_rules.mine(bad)).collect())
    assert got == [(0, "a.net", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (3, "", "", None, "allow"), (5, "a.net", "/", "net/", "block"), (6, "hhhhhhhhh", "/p/", None, "allow")]
    assert url_rules.judge(pages.limit(0), rules, url_rules.mine(bad.limit(0))).count() == 0


def test_decontamination(spark, edges, nothing):
    assert decontaminate.matched(edges, items(spark)).count() == 0
    assert decontaminate.clean(edges, items(spark)).count() == edges.count()
    assert decontaminate.clean(edges, items(spark).limit(0)).count() == edges.count()
    assert decontaminate.matched(nothing, items(spark)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(empty, spark, edges, nothing, tmp_path):
    docs = nothing if empty else edges
    sf = str(tmp_path)
    items(spark).write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() <= docs.count(), name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).count() <= docs.count()
