"""Cases that shortcuts of the operators once left out."""

import collections
import random
import zlib

import numpy as np
import pytest

from textsentry.llm import decontaminate, mixing, queries, suffix_dedup, toxicity
from textsentry.llm._run import Scope

from .conftest import prose
from .test_operators import repeated


def test_restorer_reads_what_the_pattern_finds_in_the_whole_text():
    model = toxicity.CharModel(collections.Counter({"idiot": 9, "moron": 9, "crétin": 9, "coca": 2}))
    rng = random.Random(3)
    pieces = [*"abcoé中ж01!|+@$€£¡._-*~,=²\n\t", " ", " ", " ", "..", "--", "id", "aaa", " ", "́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += ["an i..d..i..o..t here", "m**o**r**o**n", "i--d--i--o--t", "id€ot", "¡diot", "so c r é t i n x", "ééé", "и д и о т"]
    restore = toxicity.Restorer(model)
    for text in texts:
        assert restore(text) == toxicity.SUSPECT.sub(restore._read, text.lower()), text
    assert "idiot" in restore("an i..d..i..o..t here") and restore("¡diot") == "idiot" and "crétin" in restore("c r é t i n")


@pytest.mark.parametrize("hot", [512, 2])
def test_first_kept_of_repeats_within_one_text(spark, hot):
    texts = ["=" * 1000, "ab" * 400, "abcdef" * 200, f"{prose(60, 1)} {'-' * 500} {prose(60, 2)}", prose(100, 3), "#" * 79]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = repeated([t.encode() for t in texts], 80, "first")
    for r in suffix_dedup.cut_repeats(docs, length=80, hot=hot).collect():
        assert r.text == "".join(c for c, m in zip(texts[r.doc_id], gone[r.doc_id]) if not m), r.doc_id


def test_similarity_does_not_depend_on_blocks(spark):
    common = prose(12, 50, 100_000)
    items = [(i, f"{prose(14, 60 + i, 100_000)} {common if i % 3 else ''}".strip()) for i in range(12)]
    rng, texts = random.Random(5), []
    for _, t in items:
        for edits in (1, 2, 3):
            w = t.split()
            for k in rng.sample(range(len(w)), edits):
                w[k] = "changed"
            texts.append(f"{prose(9, rng.random())} {' '.join(w)} {common}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, " ")], "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.matched(docs, bench, block_items=n, similarity=0.3).collect())) for n in (5000, 3))
    assert len(one) > 10 and [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert [r[2] for r in many] == pytest.approx([r[2] for r in one], rel=1e-12)


def test_many_cells_are_raked_like_few(spark):
    rng = np.random.default_rng(7)
    # mostly one source to a language: raking takes over 12 rounds
    rows = [(f"s{i}", f"l{j}", "prose", int(rng.integers(1, 50)) * (10 if i == j else 1)) for i in range(6) for j in range(6)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    tokens = np.array([r[3] for r in rows], float)
    codes = [np.array([sorted({r[d] for r in rows}).index(r[d]) for r in rows]) for d in range(3)]
    powers = {"source": 0.2, "lang": 0.9, "topic": 1.0}
    targets = []
    for d, c in zip(mixing.DIMS, codes):
        share = np.bincount(c, tokens) ** powers[d]
        targets.append(share / share.sum())
    weight = mixing.rake(codes, tokens, targets)
    near, far = ({tuple(r[:3]): r for r in found.collect()} for found in (mixing._rake_near(cells, powers, 0.5, {}), mixing._rake_far(Scope(spark), cells, powers, 0.5, {})))
    assert [near[r[:3]][3] for r in rows] == pytest.approx(weight, rel=1e-12)
    assert [far[r[:3]][3] for r in rows] == pytest.approx(weight, rel=1e-9)
    assert [far[r[:3]][4] for r in rows] == pytest.approx([near[r[:3]][4] for r in rows], rel=1e-9)
    assert sum(r[3] * near[r[:3]][4] for r in rows) == pytest.approx(tokens.sum() / 2)


def test_anchors_of_data_longer_than_places_have_bits(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(9000), np.uint8) % 3
    data[3000:3400] = data[:400]
    monkeypatch.setattr(suffix_dedup, "_BITS", 10)
    lo, hi, anchor, code = suffix_dedup.anchors(data, np.array([0, len(data)]), 80)
    top = suffix_dedup.gram_hashes(data) >> np.uint64(10)
    want = [i + int(np.argmin(top[i : i + 49])) for i in range(len(data) - 79)]
    assert np.repeat(anchor, hi - lo + 1).tolist() == want and (np.diff(anchor) != 0).all()
    assert (code == suffix_dedup.gram_hashes(data)[anchor]).all()


def spoken(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_toxicity_learns_from_all_labelled_texts(spark, tmp_path):
    """Of 9000 labelled texts only six to learn from, as few as count, have a word; held-out texts with it are found."""
    learned = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = {*learned[700::1100], *sorted({*range(9000)} - {*learned})[::500]}
    assert len(bad & {*learned}) == 6 and len(bad) > 9
    texts = [(i, spoken(12, i) + " zorblax" * (i in bad)) for i in range(9000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in bad)) for i in range(9000)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op5_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == 9000 and {r.doc_id for r in got if r.predicted} == bad


def test_toxicity_fit_is_train_on_tables(spark):
    """Near copies, copies, repeated rows, null and empty texts, null keys and labels, hidden words and other scripts."""
    rng, rows = random.Random(3), []
    for i in range(700):
        w = spoken(30, i % 500).split()
        if i >= 500:
            w[rng.randrange(30)] = "édité"
        if i % 3 == 0:
            w.insert(rng.randrange(30), rng.choice(["moron", "m0r0n", "i.d.i.o.t", "idiot", "IDIOOOT", "дурак"]))
        rows.append((i, " ".join(w), int(i % 3 == 0 or i % 50 == 1)))
    rows += rows[:40] + [(i, t, i % 2) for i, t in enumerate([None, "", " \n", "!", "a", "a b"] * 3, 900)] + [(901, "", 1), (901, "", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, y in {(r[0], r[2]) for r in rows} | {(905, 0)}] + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    marks = {905: {0}}
    for k, _, y in rows:
        marks.setdefault(k, set()).add(y)
    known = sorted((k, y, t or "") for k, t, _ in rows for y in marks[k])
    want = toxicity.train([r[2] for r in known], [r[1] for r in known])
    got = toxicity.fit(docs.repartition(5), labels)
    assert want.weights and got.weights == want.weights and got.bias == want.bias
    assert got.model.keys.tolist() == want.model.keys.tolist() and got.model.run.tolist() == want.model.run.tolist() and got.model.size == want.model.size
    nothing = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert not nothing.weights and nothing.bias == toxicity.train([], []).bias
