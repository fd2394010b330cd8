"""Operators against plain Python on small tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsentry.llm import decontaminate, kneser_ney, langid, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, toxicity, url_rules
from textsentry.llm._run import remainder
from textsentry.llm.components import components

from .conftest import prose
from .test_text import plain_words


def shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def grouped(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            same = len(sets[i] & sets[j])
            if i < j and same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_copies(seed, copies, edits):
    rng, base = random.Random(seed), prose(150, seed, 100_000).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def test_split():
    assert zlib.crc32(b"12") % 7 == (zlib.crc32(str(12).encode())) % 7


def test_remainder(spark):
    got = spark.range(50).select("id", remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(300, 301 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == 100 and all(got[301 + i] == 300 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [2, 8])
def test_ngram_join(spark, small):
    """Groups of near copies wide enough that not all of them link, copies, and a passage shared by different texts."""
    passage = prose(40, 77, 100_000)
    texts = [t for seed, edits in ((1, 1), (2, 3), (3, 4), (4, 6)) for t in near_copies(seed, 25, edits)]
    texts += texts[:10] + [prose(100, 50 + i, 5000) + " " + passage for i in range(30)] + ["a b", "A  b", "", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = grouped({i: shingles(t) for i, t in enumerate(texts)})
    got = {r.doc_id: r.component_id for r in ngram_join.similar(docs, small=small).collect()}
    assert got == want
    kept = {r.doc_id for r in ngram_join.kept_firsts(docs, small=small).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("percent", [50, 80])
def test_members_that_can_link_with_none_leave(spark, percent):
    """All pairs that pass the filters are kept; a group without such a pair is empty."""
    rng, rows = random.Random(percent), []
    for g in range(30):
        same = g % 3 == 0
        for i in range(rng.randrange(2, 12)):
            n = 100 if same else rng.randrange(60, 140)
            rows.append((g, 1000 * g + i, n, 100 - percent if same else rng.randrange(n * (100 - percent) // 100), 1000 * g + i))
    got = {(r.g, r.id) for r in ngram_join._able(spark.createDataFrame(rows, "g long, id long, n long, pos long, label long"), percent).collect()}

    def fits(a, b):
        (n, p), (m, q) = a[2:4], b[2:4]
        return 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * min(n - p, m - q) >= percent * (n + m)

    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and fits(a, b):
            assert a[:2] in got and b[:2] in got
    assert not any(g % 3 == 0 for g, _ in got) and got


def test_a_template_that_many_unlinked_texts_share(spark):
    template = prose(160, 1, 100_000).split()
    texts = [" ".join([*template[:80], *(f"own{i}x{k}" for k in range(24)), *template[80:]]) for i in range(120)]
    texts += [t.replace("own7x3", "other") for t in texts[7:8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar(docs).collect()}
    assert got == grouped({i: shingles(t) for i, t in enumerate(texts)}) and got[120] == 7


@pytest.mark.parametrize("percent", [50, 80])
def test_linked(percent):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 40, rng.integers(0, 40)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 40, rng.integers(0, 6)).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        assert ngram_join.linked(a, b, percent) == bool(same and 100 * same >= percent * (len(a) + len(b) - same))


def repeated(texts, length, keep):
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            where[t[k : k + length]].append((i, k))
    out = [bytearray(len(t)) for t in texts]
    for places in where.values():
        for i, k in sorted(places)[keep == "first" :] if len(places) > 1 else []:
            out[i][k : k + length] = b"\1" * length
    return out


def duplicated(seed):
    rng = random.Random(seed)
    parts = [prose(30, 900 + i, 100_000) for i in range(6)]
    texts = []
    for i in range(40):
        body = [prose(rng.randrange(5, 40), 1000 + i, 100_000)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(parts)
            body.insert(rng.randrange(len(body) + 1), p[rng.randrange(20) : len(p) - rng.randrange(20)])
        texts.append(" ".join(body))
    return texts + texts[:3] + ["ab" * 200, "é" * 120, "short", ""]


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, hot):
    texts = duplicated(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone, again = (repeated([t.encode() for t in texts], n, "none") for n in (120, 70))
    for r in suffix_dedup.digests(docs, length=120, least=70, hot=hot).collect():
        marks, body = gone[r.doc_id], texts[r.doc_id].encode()
        spans = sum(m and (k == 0 or not marks[k - 1]) for k, m in enumerate(marks))
        left = bytes(b for b, m in zip(body, marks) if not m)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) == (len(body), sum(marks), spans, hashlib.sha256(left).hexdigest(), sum(again[r.doc_id])), r.doc_id


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_keeps_first(spark, hot):
    texts = duplicated(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone = repeated([t.encode() for t in texts], 80, "first")
    for r in suffix_dedup.cut_repeats(docs, length=80, hot=hot).collect():
        body = texts[r.doc_id].encode()
        if body.isascii():
            assert r.text.encode() == bytes(b for b, m in zip(body, gone[r.doc_id]) if not m), r.doc_id


def shared(a, b, most):
    n = 0
    while n < min(len(a), len(b), most) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcd"])
def test_longest_factors(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        text, most = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))), rng.randrange(1, 20)
        padded = np.concatenate((np.frombuffer(text.encode(), np.uint8) + 1, np.zeros(most, np.uint8)))
        starts = np.arange(len(text))
        order, common = suffix_dedup.suffix_array(padded, starts, np.minimum(most, len(text) - starts), most)
        ends = [text[i : i + most] for i in order]
        assert ends == sorted(ends)
        assert common.tolist() == [0, *(shared(a, b, most) for a, b in zip(ends, ends[1:]))]
        previous, following = suffix_dedup.longest_factors(order, common)
        best = lambda i, others: max((shared(text[i:], text[j:], most) for j in others), default=0)
        assert previous.tolist() == [best(i, range(i)) for i in starts]
        assert following.tolist() == [best(i, range(i + 1, len(text))) for i in starts]


def test_longest_factors_of_a_long_text():
    data = np.random.default_rng(1).integers(1, 5, 30_000).astype(np.uint8)
    data[20_000:20_500] = data[100:600]
    order, common = suffix_dedup.suffix_array(np.concatenate((data, np.zeros(400, np.uint8))), np.arange(30_000), np.minimum(400, 30_000 - np.arange(30_000)), 400)
    previous, following = suffix_dedup.longest_factors(order, common)
    assert np.flatnonzero(previous >= 240).tolist() == list(range(20_000, 20_261))
    assert following[100] == previous[20_000] == 400


def test_short_spans_stay_unless_they_have_many_words(spark):
    rng = random.Random(11)
    common, rare = (sep.join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n)) for sep, n in ((" ", 60), ("", 75)))
    parts = [prose(60, i, 100_000) for i in range(4)]
    docs = spark.createDataFrame([(0, f"{parts[0]} {common} {parts[1]} {rare}"), (1, f"{parts[2]} {common} {parts[3]} {rare}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs, length=100, over_words=50).collect()}
    assert common in got[0] and common not in got[1] and rare in got[0] and rare in got[1]
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs, length=100, over_words=50, always=120).collect()}
    assert rare in got[0] and rare not in got[1]


def test_decontaminate(spark):
    items = [(i, prose(n, 300 + i, 100_000)) for i, n in enumerate((14, 25, 40, 59, 3))]
    rng = random.Random(1)

    def hidden(text, edits=0):
        w = text.split()
        for _ in range(edits):
            w[rng.randrange(len(w) // 2)] = "changed"
        return f"{prose(rng.randrange(60), rng.random(), 5000)} {' '.join(w)} {prose(rng.randrange(60), rng.random(), 5000)}"

    texts = [hidden(t) for _, t in items] + [items[2][1], hidden(items[3][1], 1), prose(300, 9, 5000), " ".join(items[3][1].split()[:25])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 2), (6, 3)}
    for block in (5000, 2):
        got = decontaminate.matched(docs, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.similarity == pytest.approx(1) for r in got if r.doc_id != 6)
        assert {r.doc_id for r in decontaminate.clean(docs, bench, block_items=block).collect()} == {7, 8}


@pytest.mark.parametrize("radius", [0, 9, 18])
def test_hamming_index_finds_all_within_radius(radius):
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    codes = []
    for p in prints:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, radius + 4), replace=False)
            codes.append(int(p) ^ sum(1 << int(f) for f in flips))
    codes = np.array(codes, np.uint64)
    got = set(zip(*(x.tolist() for x in decontaminate.Hamming(prints, radius).pairs(codes))))
    assert got == {(i, j) for i, c in enumerate(codes.tolist()) for j, p in enumerate(prints.tolist()) if (c ^ p).bit_count() <= radius}


def brute_similarity(item, window, items):
    rare = collections.Counter(g for t in items for g in shingles(t))
    grams = lambda words: collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    weight = lambda g: math.log(1 + len(items) / max(1, rare[g]))
    a, b = grams(item.split()), grams(window)
    return sum(weight(g) * min(a[g], b[g]) for g in a | b) / sum(weight(g) * max(a[g], b[g]) for g in a | b)


def test_passages_near_the_limit_are_found(spark):
    """Against all windows, the share found of pairs whose similarity is from 0.8 to 0.9; none below is."""
    rng, common = random.Random(4), prose(20, 8, 100_000)
    items = [f"{prose(rng.randrange(30, 70), 700 + i, 100_000)} {common if i % 4 == 0 else ''}".strip() for i in range(40)]
    texts, want = [], {}
    for i, t in enumerate(items):
        for _ in range(4):
            w = t.split()
            for k in rng.sample(range(len(w)), rng.choice((1, 1, 2))):
                w[k] = f"changed{k}"
            text = [*prose(20, rng.random(), 5000).split(), *w, *prose(20, rng.random(), 5000).split()]
            n = len(t.split())
            want[len(texts), i] = max(brute_similarity(t, text[s : s + n], items) for s in range(len(text) - n + 1))
            texts.append(" ".join(text))
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((texts, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matched(docs, bench).collect()}
    near = [k for k, v in want.items() if 0.8 <= v < 0.9]
    assert len(near) > 30 and sum(k in got for k in near) >= 0.95 * len(near)
    assert all(got[k] == pytest.approx(want[k]) for k in near if k in got)
    assert not [k for k, v in want.items() if v < 0.8 and k in got]
    with pytest.raises(ValueError, match="split"):
        decontaminate.matched(docs, bench, most_items=10)


def test_rake_and_calibrate():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, k, 60) for k in (4, 3, 2)]
    tokens = rng.integers(1, 100, 60).astype(float)
    targets = [np.full(k, 1 / k) for k in (4, 3, 2)]
    w = mixing.rake(codes, tokens, targets)
    for c, t in zip(codes, targets):
        assert np.bincount(c, tokens * w) / (tokens * w).sum() == pytest.approx(t, abs=1e-6)
    c = mixing.calibrate(lambda c: (tokens[c * w >= 1].sum(), (tokens * w)[c * w < 1].sum()), tokens.sum(), 1 / w.min(), 0.4)
    assert (tokens * np.minimum(1, c * w)).sum() == pytest.approx(0.4 * tokens.sum())


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng.randrange(5, 30), i) + (" @" if i % 9 == 0 else ""), rng.choice(["en", "fr", None]), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    near, far = (mixing.mixed(docs, near_cells=n).cache() for n in (1000, 0))
    shares = {}
    for d in ("source", "lang", "topic"):
        own = {r[0]: r for r in near.groupBy(d).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
        total = sum(r[2] for r in own.values())
        want = mixing.tempered({k: r[1] for k, r in own.items()}, mixing.POWERS[d])
        shares[d] = {k: (r[2] / total, want[k]) for k, r in own.items()}
        assert all(a == pytest.approx(b, abs=1e-6) for a, b in shares[d].values())
    kept = near.where("kept").agg(F.sum("n_tokens")).first()[0] / near.agg(F.sum("n_tokens")).first()[0]
    assert kept == pytest.approx(0.5, abs=0.04)
    p = {r[0].doc_id: r[1] for r in near.select("__row", "probability").collect()}
    assert all(r[1] == pytest.approx(p[r[0].doc_id], rel=1e-9) for r in far.select("__row", "probability").collect())


@pytest.mark.parametrize("near", [1000, 0])
def test_mixing_to_given_targets(spark, near):
    rng = random.Random(3)
    rows = [(i, prose(rng.randrange(5, 30), i), rng.choice(["en", "fr", None, "", "x"]), rng.choice("ab"), rng.choice("pq"), 1.5) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string, mix_weight double")
    targets = {"lang": {"en": 3, "fr": 1, None: 1, "": 0.5, "nowhere": 7}, "topic": {"p": 0.75, "q": 0.25}}
    out = mixing.mixed(docs, topic="subject", targets=targets, near_cells=near).cache()
    got = {r[0]: r[1] for r in out.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
    total = sum(got.values())
    assert {k: x / total for k, x in got.items()} == pytest.approx({"en": 3 / 5.5, "fr": 1 / 5.5, None: 1 / 5.5, "": 0.5 / 5.5, "x": 0})
    got = {r[0]: r[1] for r in out.groupBy("topic").agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
    assert got["p"] / total == pytest.approx(0.75)
    assert out.where("lang = 'x' and (kept or mix_weight is not null)").count() == 0
    again = mixing.sampled(mixing.sampled(docs, topic="subject", targets=targets, near_cells=near), near_cells=near)
    assert again.columns == ["doc_id", "text", "lang", "source", "subject", "mix_topic", "mix_weight"] and again.count() > 300


def test_kneser_ney(spark):
    texts = [prose(60, i, 50) for i in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = kneser_ney.fit(docs.where("doc_id <> 3"))
    c, two = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        if i != 3:
            w = [*plain_words(t), "</s>"]
            c.update(w)
            two.update(zip(["<s>", *w], w))
    before, after = collections.Counter(w for _, w in two), collections.defaultdict(list)
    for (u, _), n in two.items():
        after[u].append(n)
    kinds = lambda v: [sum(x == k for x in v) for k in (1, 2, 3, 4)]
    d2, d1 = [(0, *kneser_ney.discounts(*kinds(list(v)))) for v in (two.values(), before.values())]
    rest = sum(d1[min(n, 3)] for n in before.values()) / len(two)

    def p(u, w):
        low = (before[w] - d1[min(before[w], 3)]) / len(two) + rest / (len(c) + 1)
        if u not in after:
            return low
        n = two[(u, w)]
        return (n - d2[min(n, 3)]) / sum(after[u]) + sum(d2[min(x, 3)] for x in after[u]) / sum(after[u]) * low

    assert sum(p("w1", w) for w in [*c, "never"]) == pytest.approx(1)
    for r in kneser_ney.scored(docs, model).collect():
        w = [*plain_words(texts[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), sum(c.values()))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w)))


@pytest.mark.parametrize("most", [1, 3])
def test_few_files_are_mapped_at_a_time(spark, most):
    docs = spark.createDataFrame([(i, prose(200, i)) for i in range(20)], "doc_id long, text string")
    model = kneser_ney.fit(docs, bucket_bytes=500)
    assert model.bits >= 4
    every, few = kneser_ney.Reader(model), kneser_ney.Reader(model, most)
    words = np.concatenate([np.fromfile(f"{model.path}/word-{i}", np.uint64) for i in range(1 << model.bits) if os.path.exists(f"{model.path}/word-{i}")])
    rng = np.random.default_rng(1)
    hashes = rng.permutation(np.concatenate((words, words[:50] + np.uint64(1))))
    (n, c), (number, count) = every.numbers(hashes), few.numbers(hashes)
    assert (n == number).all() and (c == count).all() and int(c.sum()) == model.tokens
    p = every.probabilities(np.roll(number, 1), number)
    assert (p == few.probabilities(np.roll(number, 1), number)).all() and len(few.maps.open) <= most < len(every.maps.open)


LETTERS = {"en": "the of and tion ing er re th", "fr": "le la que é eau ou ment tre", "de": "der die und sch ung keit ei ch"}


def language(lang, seed):
    rng = random.Random(seed)
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60))


def test_langid(spark):
    rows = [(i, language(g, i), g) for i, g in enumerate(list(LETTERS) * 30)]
    docs = spark.createDataFrame([*rows, (900, "123 --", "en"), (901, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit_dictionaries(docs.where("doc_id % 2 = 0"))).collect()}
    assert sum(got[i].lang_pred == g for i, _, g in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].rejected


def test_langid_against_all_dictionaries(spark):
    """Leaving other scripts out changes no answer, and rare languages have their dictionary."""
    cyrillic = str.maketrans("abcdefghiklmnoprstuvyzéw", "абцдефгхиклмнопрстувызэш")
    rows = []
    for i in range(160):
        g = list(LETTERS)[i % 3]
        rows.append((i, language(g, i), g) if i % 2 else (i, language(g, i).translate(cyrillic), f"{g}-cyr"))
    rows += [(1000 + i, "".join(chr(0x4E00 + random.Random(100 * i + k).randrange(90)) for k in range(80)), f"rare{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.fit_dictionaries(docs)
    assert found.keys() == {g for _, _, g in rows}
    with pytest.raises(ValueError, match="languages"):
        langid.fit_dictionaries(docs, most_langs=20)
    few = {g: d for g, d in found.items() if not g.startswith("rare")} | {g: found[g] for g in ("rare1", "rare2")}
    classify, every = langid.Classifier(few, 3), langid.Classifier(few, 3)
    every.tried = [list(range(len(few)))] * len(langid._SCRIPTS)
    assert all(len(classify.tried[k]) < len(few) for k in (0, 2, 9)) and len(classify.tried[4]) == len(few)
    assert all(classify(t)[0] == every(t)[0] for _, t, g in rows if g in few)
    assert langid.Classifier(found, 3)(rows[-1][1])[0] == rows[-1][2]


def test_quality_classifier(spark):
    texts = [language("en", i) if i % 3 else " ".join(w + "%%%" for w in language("en", i).split()) for i in range(240)]
    y = np.array([int(i % 3 > 0) for i in range(240)])
    model = quality_classifier.train(texts[:160], y[:160], epochs=6)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.predicted for r in quality_classifier.scored(docs, model).orderBy("doc_id").collect()]
    assert np.mean(np.array(got)[160:] == y[160:]) > 0.95


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcd", "abcde", None])
def test_classifier_alone_with_a_short_text(text):
    import pyarrow as pa

    model = quality_classifier.train(["some words", "other"], np.array([0, 1]), epochs=1)
    assert model.probabilities(pa.array([text], pa.string())).sum() == pytest.approx(1)
    # a chunk of its own, after a text that fills one
    assert model.probabilities(pa.array(["x y " * (1 << 20), text], pa.string())).shape == (2, 2)


def test_classifier_repeats():
    import pyarrow as pa

    off, data = quality_classifier.raw(pa.array(["a a b", "b b"]))
    kinds = list(quality_classifier.features(off, data, 10))
    assert (kinds[1][0] == 1023).tolist() == [False, True, False, False, True]
    assert kinds[2][1].tolist() == [0, 3, 4]


def test_classifier_counts_characters():
    import pyarrow as pa

    off, data = quality_classifier.raw(pa.array(["é中😀é中", "xé", "é中😀"]))
    _, _, three, five = quality_classifier.features(off, data, 20)
    assert three[1].tolist() == [0, 3, 3, 4] and five[1].tolist() == [0, 1, 1, 1]
    assert three[0][0] == three[0][3] and len(set(three[0].tolist())) == 3


def test_toxicity(spark):
    rng, bad = random.Random(4), ["moron", "pathetic", "idiot"]
    texts, toxic = [], []
    for i in range(300):
        w = language("en", i).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    tox = toxicity.train(texts, toxic)
    plain = language("en", 9999)
    hidden = ["m0r0n", "p4th3t1c", "i d i o t", "i.d.i.o.t", "idioooot", "MORON!!", "1d10t"]
    docs = spark.createDataFrame(list(enumerate([f"{plain} {h} {plain}" for h in hidden] + [plain, "", None])), "doc_id long, text string")
    got = [r for r in toxicity.scored(docs, tox, restored=True).orderBy("doc_id").collect()]
    assert [r.predicted for r in got] == [1] * len(hidden) + [0, 0, 0]
    assert "idiot" in got[2].restored and got[7].restored == plain


def readings(span, i, past, model):
    """(cost, text) of every path."""
    if i == len(span):
        yield (model.cost(past, " ") if past[1] != " " else 0.0), ""
        return
    for state, cost, read in toxicity._ways(span, i, past, model, 0.7, 0.2, 0.1, 6.0, 0.2):
        for more, rest in readings(span, i + 1, state, model):
            yield cost + more, read + rest


def test_decoding_finds_the_cheapest_reading():
    model = toxicity.CharModel(collections.Counter({"such": 20, "an": 30, "idiot": 9, "stupid": 5, "you": 40, "well": 9, "known": 9}))
    rng = random.Random(2)
    for _ in range(150):
        span = "".join(rng.choice("suchidiot1!.- $0aan") for _ in range(rng.randrange(1, 8)))
        found = list(readings(span, 0, "  ", model))
        least, got = min(found)[0], toxicity.decode(span, model)
        assert any(text == got and cost == pytest.approx(least) for cost, text in found), span
    restore = toxicity.Restorer(model)
    for text, want in {"s u c h i d i o t": "such idiot", "such-an-idiot": "such an idiot", "you stupid-idiot": "you stupid idiot", "w.e.l.l k_n_o_w_n": "well known", "y0u $tup1d": "you stupid", "a" * 70 + "n": "an"}.items():
        assert restore(text) == want


def test_long_spans_and_words_are_read_whole(spark):
    word = "antidis" * 6
    texts = [f"{language('en', i)} {word}" if i % 4 == 0 else language("en", i) for i in range(200)]
    tox = toxicity.train(texts, [int(i % 4 == 0) for i in range(200)], sizes=range(0))
    score = tox.scorer()
    assert f" {word} " in tox.weights and score(f"x {word}")[0] > 0.5 > score(f"x {word[:24]}")[0]
    spread = ".".join(word)
    assert score(f"x {spread}")[2] == [f" {word} "]
    assert len(score("i." * 50_000 + "i")[1]) <= 100_001


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(tri)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)})


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é#|\n \t") for _ in range(rng.randrange(200))) for _ in range(150)] + ["a b c a b c a b c", "x", "", "l\nl\n\nl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measured(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])


def test_quality_rules(spark):
    good = [f"{language('en', i)} {language('en', i + 1000)}." for i in range(120)]
    junk = [" ".join(w + "***" for w in t.split()) for t in good[:20]] + [" ".join(w.upper() + "!!" for w in t.split()) for t in good[20:40]]
    docs = spark.createDataFrame(list(enumerate(good + junk + ["too short"])), "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.accepted(docs).collect()}
    assert kept == set(range(120))


def test_em_recovers_accuracies():
    rng = random.Random(1)
    right, rows = (0.95, 0.8, 0.7, 0.9), collections.Counter()
    for _ in range(20_000):
        y = rng.random() < 0.7
        rows[tuple(int(y == (rng.random() < a)) if rng.random() < 0.8 else None for a in right)] += 1
    prior, found = quality_rules.estimate(list(rows.items()), 4, rounds=200)
    assert prior == pytest.approx(0.7, abs=0.03)
    assert found == pytest.approx(right, abs=0.04)


URLS = ["http://a.example.net/en/1", "http://example.net/de/", "https://b.example.com/de/x?y=1", "http://example.com/en/", "http://x.org/fr/", "http://x.org/en/", "ftp://NET/", "http://net", "mynet://badnet/", "x", None, "http://example.net.evil.org/en/#f"]


def brute_url(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow")))


def test_fixed_url_rules(spark):
    from textsentry.llm.queries import URL_RULES

    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in url_rules.judge(pages, URL_RULES, url_rules.Mined()).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(URLS[r.page_id], URL_RULES)


def test_mined_url_rules(spark):
    """Rules are those of a search through all combinations; they block what has all tokens of one."""
    rng = random.Random(5)
    rows = []
    for i in range(1600):
        host, section = rng.choice(["shop", "news", "blog"]), rng.choice(["win", "read", "about"])
        rows.append((i, f"http://{host}.site{i % 7}.com/{section}/{i}", rng.random() < (0.9 if host == "shop" and section == "win" else 0.1) if i % 2 else None))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = url_rules.mine(pages, min_support=0.01)
    baskets = []
    for r in url_rules._parts(pages.where("bad is not null"), ("bad",), "url").select("bad", "__tokens").collect():
        baskets.append((r[0], frozenset(r[1])))
    seen, hit = collections.Counter(), collections.Counter()
    for b, tokens in baskets:
        for size in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), size):
                seen[x] += 1
                hit[x] += b
    sets = [x for x in seen if hit[x] >= 0.01 * len(baskets)]
    share = sum(b for b, _ in baskets) / len(baskets)
    assert (mined.pages, mined.looked_at) == (800, len(sets)) and mined.bad_share == pytest.approx(share)
    assert mined.best_confidence == pytest.approx(max(hit[x] / seen[x] for x in sets))
    z = statistics.NormalDist().inv_cdf(1 - 0.05 / len(sets))

    def lower(c, m):
        return (c + z * z / (2 * m) - z * math.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)

    good = {x: hit[x] / seen[x] for x in sets if hit[x] / seen[x] >= 1.2 * share and lower(hit[x] / seen[x], seen[x]) > share}
    want = {x: c for x, c in good.items() if not any(set(y) < set(x) and good[y] >= c for y in good)}
    assert {tuple(r.tokens): r.confidence for r in mined.rules} == pytest.approx(want) and ("first=shop", "path=win") in want
    tokens = {r[0]: set(r[1]) for r in url_rules._parts(pages, ("page_id",), "url").select("page_id", "__tokens").collect()}
    for r in url_rules.judge(pages, [], mined).collect():
        fits = [x for x in mined.rules if set(x.tokens) <= tokens[r.page_id]]
        assert (r.verdict, r.mined or None, r.confidence) == (("block", " ".join(fits[0].tokens), fits[0].confidence) if fits else ("allow", None, None))
    with pytest.raises(ValueError, match="min_support"):
        url_rules.mine(pages, min_support=0.01, most_rules=0)
