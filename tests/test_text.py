import re

import pytest
from pyspark.sql import functions as F

from textsentry.functions import text as T
from textsentry.functions.validators import ipv4, luhn, ssn


def column(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]



@pytest.fixture(scope="module", autouse=True)
def column_t(spark):
    """Columns need a session."""
    global t
    t = F.col("t")



@pytest.mark.parametrize("pattern", [r"\d+", r"(?<=a)b", r"\bé\w*", r"a|ab", r"😀."])
def test_spans_equal_python(spark, pattern):
    texts = ["", "12 a1 345", "ab aab b", "é éa 😀x 😀😀", "aaa\nab 7"]
    got = column(spark, texts, T.spans(t, pattern))
    assert [[(s.text, s.start, s.end) for s in r[0]] for r in got] == [[(m.group(), m.start(), m.end()) for m in re.finditer(pattern, x)] for x in texts]


def test_strip_blank_words(spark):
    texts = [" \t a b\n", "", None, " ", "x"]
    got = column(spark, texts, T.strip(T.text_of(t)), T.blank(t), T.word_count(T.text_of(t)))
    assert got == [("a b", False, 2), ("", True, 1), ("", True, 1), ("", True, 1), ("x", False, 1)]


def test_counts(spark):
    assert column(spark, ["aXaXa", "aaaa"], T.count_of(t, "aa"), T.count_matches(t, "A", "i")) == [(0, 3), (2, 4)]


def test_round4_equals_python(spark):
    values = [k / 8192 for k in range(0, 8192, 37)] + [0.95 * 0.7 + 0.225 * 0.3, -0.00001, 0.12345, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(T.round4(F.col("v"))).collect()]
    assert got == [round(v, 4) + 0.0 for v in values]


def test_validators(spark):
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "0", "", "18"]
    assert [r[0] for r in column(spark, cards, luhn(t))] == [True, False, True, False, False, True]
    numbers = ["123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "12-3"]
    assert [r[0] for r in column(spark, numbers, ssn(t))] == [True] + [False] * 6
    hosts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "0.0.0.0", "1.2.3", "a.b.c.d"]
    assert [r[0] for r in column(spark, hosts, ipv4(t))] == [True, False, False, True, False, False]
