"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes good (1) or bad (0) or abstains (null).  Votes are counted by
pattern, at most 3**rules patterns whatever the number of rows; expectation
maximisation on those counts estimates how often each rule is right, and the
posterior probability of good quality decides, not the worst single rule.

Defined cases: a null text has no words; a text without words abstains from
every ratio; equal rows get equal results; an empty table keeps the starting
estimates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import Scope

#: Fixed by the contract: what separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _among(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame, *, keep: tuple[str | Column, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and counts over whole texts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the query
    contract defines them; besides n_lines (with a word), n_upper, n_shout
    (exclamation marks) and n_punct (ASCII punctuation).  Windows of words are
    compared by hashes, of 64 bits less those that number a text's words.
    """
    names = docs.select(*keep).columns
    t, w, r, h, s, p = (F.col(f"__{c}") for c in "twrhsp")
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    # a split at one character needs no pattern
    out = out.withColumn("__w", F.array_remove(F.split(F.translate(t, SPACES[1:], " " * 5), " "), ""))
    out = out.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    # what most characters are is counted nowhere: the rest is short
    out = out.withColumn("__r", F.regexp_replace(t, "[a-z \n]+", ""))
    out = out.select(
        *names,
        F.col("__w"),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _among(r, SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        _among(r, _UPPER).alias("n_upper"),
        _among(r, "!").alias("n_shout"),
        _among(r, _PUNCT).alias("n_punct"),
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("__h"),
    )
    # where a window repeats: its hash, less the top bits that its place takes, sorted as one number with the place
    bits = F.ceil(F.log2(F.size(h) + 1)).cast("int")
    place = (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("place")
    packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
    out = out.select(*[c for c in out.columns if c != "__w"], F.when(F.size(F.array_distinct("__h")) < F.size("__h"), packed).alias("__s"), bits.alias("__b"), place.alias("__m"))
    key = lambda x: F.call_function("shiftright", x, F.col("__b"))
    same = lambda x, i: F.coalesce(key(F.get(s, i)) == key(x), F.lit(False))
    places = F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(F.col("__m")))
    out = out.withColumn("__p", F.sort_array(places))
    steps = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    return out.drop("__h", "__s", "__b", "__m", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bad(when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), 0)


def _good(when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), 1)


def default_rules() -> dict[str, Column]:
    """Votes over the columns of :func:`measured`: each symptom votes bad or abstains; punctuation and the whole picture vote either way, so that a symptom meets a second witness."""
    words, chars = F.col("n_words"), F.col("word_chars")
    mean = F.when(words > 0, chars / words)
    calm = (words > 0) & (20 * F.col("n_symbols") <= words) & (10 * F.col("n_upper") <= chars) & (50 * F.col("n_shout") <= words)
    fresh = (10 * F.col("n_dup_lines") <= F.col("n_lines")) & (10 * F.col("n_repeat_words") <= words)
    return {
        "symbols": _bad(10 * F.col("n_symbols") > words),
        "lines": _bad(10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _bad(100 * F.col("n_repeat_words") > 30 * words),
        "word_size": _bad((mean < 2) | (mean > 14)),
        "capitals": _bad(10 * F.col("n_upper") > 4 * chars),
        "shouting": _bad(10 * F.col("n_shout") > words),
        "punctuation": _good(20 * F.col("n_punct") <= chars).otherwise(_bad(100 * F.col("n_punct") > 8 * chars)),
        "prose": _good(calm & fresh & (mean >= 3) & (mean <= 9)).otherwise(_bad(~(calm & fresh))),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, *, rounds: int = 40, prior: float = 0.8, right: float = 0.9, pseudo: float = 10.0) -> tuple[float, list[float]]:
    """EM over (votes, rows): the share of good rows and each rule's accuracy, of the votes it casts.

    ``pseudo`` votes at the starting accuracy keep a rule that hardly votes
    near it; accuracies stay in [0.5, 0.99], the share in [0.01, 0.99].
    """
    found = [right] * rules
    for _ in range(rounds if patterns else 0):
        total = good = 0.0
        hit, cast = [pseudo * right] * rules, [pseudo] * rules
        for votes, n in patterns:
            p = posterior(votes, prior, found)
            total += n
            good += n * p
            for j, v in enumerate(votes):
                if v is not None:
                    cast[j] += n
                    hit[j] += n * (p if v else 1 - p)
        prior = min(0.99, max(0.01, good / total))
        found = [min(0.99, max(0.5, h / c)) for h, c in zip(hit, cast)]
    return prior, found


def posterior(votes: tuple[int | None, ...], prior: float, found: list[float]) -> float:
    """P(good | votes), rules being independent given the quality."""
    x = math.log(prior / (1 - prior))
    for v, a in zip(votes, found):
        if v is not None:
            x += math.log(a / (1 - a)) * (1 if v else -1)
    return 1 / (1 + math.exp(-x))


def judged(measures: DataFrame, *, rules: dict[str, Column] | None = None, least: float = 0.5, **fit: float) -> DataFrame:
    """``measures`` with base_failed, quality (the posterior) and kept.

    ``measures`` is read twice: once to count vote patterns, once to judge;
    pass a written table where it is dear to compute.
    """
    rules = rules or default_rules()
    counted = measures.select(*[v.cast("int").alias(f"v{i}") for i, v in enumerate(rules.values())]).groupBy(*[f"v{i}" for i in range(len(rules))]).count()
    patterns = sorted(((tuple(r)[:-1], r[-1]) for r in counted.collect()), key=str)
    prior, found = estimate(patterns, len(rules), **fit)
    x = F.lit(math.log(prior / (1 - prior)))
    for v, a in zip(rules.values(), found):
        x = x + F.when(v == 1, math.log(a / (1 - a))).when(v == 0, -math.log(a / (1 - a))).otherwise(0.0)
    out = measures.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-x)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def accepted(docs: DataFrame, *, text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.  Rows and measures are written once and read twice."""
    scope = Scope(docs.sparkSession)
    rows = scope.written(measured(docs, keep=(F.struct("*").alias("__row"),), text=text), "measured")
    return scope.owned(judged(rows, **options).where("kept").select("__row.*"), rows)
