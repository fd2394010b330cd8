import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textsentry.llm._text import Words, chunks, raw, sets_of


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t中", max_size=30)), max_size=6))
def test_words_and_shingles(texts):
    off, data = raw(pa.array(texts, pa.string()))
    w = Words(off, data)
    mine = [plain_words(t) for t in texts]
    assert np.diff(w.at).tolist() == [len(x) for x in mine]
    names = {}
    for h, x in zip(w.hash.tolist(), [x for m in mine for x in m]):
        assert names.setdefault(h, x) == x
    assert len(names) == len({x for m in mine for x in m})
    for got, m in zip(sets_of(pa.array(texts, pa.string()), 3), mine):
        want = {tuple(m[i : i + 3]) for i in range(len(m) - 2)} if len(m) >= 3 else {tuple(m)} if m else set()
        assert len(got) == len(want)


def test_equal_shingles_have_equal_hashes_across_rows_and_chunks():
    a, b = list(sets_of(pa.array(["x y z q", "p x y z q r"]), 3))
    assert set(a.tolist()) < set(b.tolist())


def test_chunks_cover_all_rows():
    off = np.array([0, 5, 5, 100, 101, 300])
    found = list(chunks(off, 50))
    assert [i for a, b in found for i in range(a, b)] == [0, 1, 2, 3, 4]


def test_sliced_arrays():
    col = pa.array(["a b", "c", None, "d e f"]).slice(1)
    off, data = raw(col)
    assert np.diff(Words(off, data).at).tolist() == [1, 0, 3]
