"""Sentiment by valence words, with negation, intensifiers and emphasis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog import sentiment as catalog
from textsentry.functions.text import count_of, let, round4, rx, text_of, words


class SentimentAnalyzer:
    def __init__(self, neutral_threshold: float = 0.1, positive: dict[str, float] | None = None, negative: dict[str, float] | None = None):
        self.neutral = neutral_threshold
        positive, negative = catalog.POSITIVE | (positive or {}), catalog.NEGATIVE | (negative or {})
        self.valences = negative | positive

    def _values(self, tokens: Column) -> Column:
        """For each token its kind and value: struct(negation, factor, valence), null where it is none."""
        by: dict[float, list[str]] = {}
        for w, v in self.valences.items():
            by.setdefault(v, []).append(w)
        factors: dict[float, list[str]] = {}
        for w, v in catalog.INTENSIFIERS.items():
            factors.setdefault(v, []).append(w)

        def value(t: Column) -> Column:
            valence, factor = F.lit(None).cast("double"), F.lit(None).cast("double")
            for v, ws in by.items():
                valence = F.when(t.isin(ws), v).otherwise(valence)
            for v, ws in factors.items():
                factor = F.when(t.isin(ws), v).otherwise(factor)
            known = t.isin(sorted({*self.valences, *catalog.INTENSIFIERS}))
            valence, factor = F.when(known, valence), F.when(known, factor)
            return F.struct(t.isin(catalog.NEGATIONS + catalog.CONTRACTIONS).alias("negation"), factor.alias("factor"), valence.alias("valence"))

        return F.transform(tokens, value)

    def _fold(self, values: Column) -> Column:
        """struct(window, factor, n, sum, above): counted words, their sum, and how many are not below 0.

        A negation reaches over the next three tokens that are neither
        negations nor intensifiers.  An intensifier lasts to the next token,
        or one further if a valence word follows that.
        """
        pairs = F.transform(values, lambda v, i: F.struct(v.alias("now"), F.get(values, i + 1)["valence"].isNotNull().alias("next")))
        start = F.struct(F.lit(0).alias("window"), F.lit(1.0).alias("factor"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("above"))

        def state(window: Column, factor: Column, n: Column, total: Column, above: Column) -> Column:
            return F.struct(window.alias("window"), factor.alias("factor"), n.alias("n"), total.alias("sum"), above.alias("above"))

        def step(s: Column, p: Column) -> Column:
            v, counted = p["now"], p["now"]["valence"].isNotNull()
            worth = v["valence"] * s["factor"] * F.when(s["window"] > 0, catalog.NEGATED).otherwise(1.0)
            factor = F.when(counted | ~F.coalesce(p["next"], F.lit(False)), 1.0).otherwise(s["factor"])
            usual = state(F.greatest(s["window"] - 1, F.lit(0)), factor, s["n"] + counted.cast("int"), s["sum"] + F.when(counted, worth).otherwise(0.0), s["above"] + F.when(counted & (worth >= 0), 1).otherwise(0))
            return F.when(v["negation"], state(F.lit(catalog.REACH), s["factor"], s["n"], s["sum"], s["above"])).when(v["factor"].isNotNull(), state(s["window"], v["factor"], s["n"], s["sum"], s["above"])).otherwise(usual)

        return F.aggregate(pairs, start, step)

    def analyze(self, text: Column) -> Column:
        """struct(sentiment, score in [-1, 1], confidence in [0, 1]); neutral, 0 and 0 for a text without valence words."""
        low = text_of(text)
        values = self._values(F.regexp_extract_all(F.lower(low), F.lit(rx(r"[a-z]+(?:'[a-z]+)?")), 0))
        parts = F.struct(let(values, self._fold).alias("s"), let(F.struct(low.alias("text"), words(low).alias("parts")), _emphasis).alias("emphasis"))
        return let(parts, lambda p: F.when(p["s"]["n"] > 0, let(_score(p), lambda r: self._result(p["s"], r))).otherwise(F.struct(F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))))

    def _result(self, s: Column, score: Column) -> Column:
        agree = F.when(score >= 0, s["above"]).otherwise(s["n"] - s["above"]) / s["n"]
        sure = 0.4 * F.abs(score) + 0.35 * agree + 0.25 * F.least(F.lit(1.0), F.ln(s["n"] + 1) / F.ln(F.lit(10.0)))
        name = F.when(F.abs(score) < self.neutral, "neutral").when(score > 0, "positive").otherwise("negative")
        return F.struct(name.alias("sentiment"), round4(score).alias("score"), round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).alias("confidence"))


def _emphasis(p: Column) -> Column:
    """A factor for exclamation marks and words in capitals."""
    shouts, parts = count_of(p["text"], "!"), p["parts"]
    loud = F.size(F.filter(parts, lambda w: w.rlike(rx(r"^\p{L}{3,}\z")) & (F.upper(w) == w) & (F.lower(w) != w))) / F.greatest(F.size(parts), F.lit(1))
    return let(loud, lambda x: 1.0 + F.when(shouts > 0, F.least(shouts * 0.05, F.lit(0.2))).otherwise(0.0) + F.when(x > 0.1, F.least(x * 0.3, F.lit(0.15))).otherwise(0.0))


def _score(p: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["s"]["sum"] / p["s"]["n"] * p["emphasis"]))
