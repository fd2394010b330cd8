"""Tables belong to the call that wrote them."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import corpus_pipeline
from textsentry.llm import _run, ngram_join, suffix_dedup

from .conftest import prose
from .test_operators import near_copies


def tables(spark):
    return {x for x in os.listdir(_run.local_path(_run.shared_dir(spark))) if not x.startswith("kneser-ney")}


def docs_of(spark, seed):
    texts = [t for s in range(3) for t in near_copies(seed + s, 12, 2)] + [prose(80, seed + 50 + i, 9000) for i in range(6)]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_calls_at_once_do_not_see_each_other(spark):
    before = tables(spark)

    def both(seed):
        docs = docs_of(spark, seed)
        a, b = ngram_join.similar(docs), suffix_dedup.digests(docs, length=120, least=70)
        out = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
        _run.discard(a)
        _run.discard(b)
        return out

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(both, (100, 200)))
    assert found == [both(100), both(200)]
    assert tables(spark) == before


def test_pipelines_at_once_leave_nothing(spark, tmp_path):
    before = tables(spark)
    dirs = []
    for seed in (300, 400):
        dirs.append(str(tmp_path / str(seed)))
        docs_of(spark, seed).write.parquet(f"{dirs[-1]}/documents.parquet")
        spark.createDataFrame([(1, prose(20, 9))], "item_id long, text string").write.parquet(f"{dirs[-1]}/benchmark.parquet")

    def whole(sf):
        out = corpus_pipeline.run(spark, sf)
        rows = sorted(r.doc_id for r in out.collect())
        _run.discard(out)
        return rows

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(whole, dirs))
    assert found == [whole(sf) for sf in dirs]
    assert tables(spark) == before


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _run.shared_dir(Cluster())
