"""Lexical toxicity by category."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog import toxicity as catalog
from textsentry.functions.text import blank, has, let, round4, strip, text_of, word_count

_START = r"\b"


class ToxicityClassifier:
    """``extra``: more (word, weight) by category; an unknown category is an error."""

    def __init__(self, threshold: float = 0.5, extra: dict[str, list[tuple[str, float]]] | None = None):
        self.threshold = threshold
        self.entries = {k: [(rf"\b{re.escape(w)}\b", n) for w, n in catalog.WORDS[k]] + catalog.PATTERNS[k] for k in catalog.WORDS}
        for k, words in (extra or {}).items():
            if k not in self.entries:
                raise ValueError(f"unknown category {k!r}")
            self.entries[k] = self.entries[k] + [(rf"\b{re.escape(w)}\b", n) for w, n in words]

    def scores(self, text: Column) -> Column:
        """struct of the categories' unrounded scores; 0 for blank and null texts.

        An entry counts once however often it occurs; long texts are dampened.
        """
        low = strip(F.lower(text_of(text)))
        parts = F.struct(low.alias("low"), word_count(low).alias("n"), blank(text_of(text)).alias("blank"))
        return let(parts, lambda p: self._scores(p["low"], p["n"], p["blank"]))

    def _scores(self, low: Column, n: Column, zero: Column) -> Column:
        damp = F.when(n <= 10, 1.0).otherwise(F.greatest(1.0 / (1.0 + 0.15 * F.ln(n / 10)), F.lit(0.3)))
        # all entries start at a word: one search for any of them spares clean texts the rest
        anywhere = has(low, r"\b(?:" + "|".join(f"(?:{r.removeprefix(_START)})" for found in self.entries.values() for r, _ in found) + ")", "i")
        raw = {k: reduce(lambda a, b: a + b, [F.when(has(low, r, "i"), w).otherwise(0.0) for r, w in found], F.lit(0.0)) for k, found in self.entries.items()}
        none = zero | ~anywhere
        return let(none, lambda none: F.struct(*[F.when(none, 0.0).otherwise(F.least(F.least(x, F.lit(1.0)) * damp, F.lit(1.0))).alias(k) for k, x in raw.items()]))

    def judged(self, scores: Column) -> Column:
        """struct(is_toxic, overall_score, the categories' scores, flagged_categories by name, threshold) of :meth:`scores`.

        Flags are set on unrounded scores, the overall mean is of rounded ones.
        """
        overall = reduce(lambda a, b: a + b, [round4(scores[k]) * w for k, w in catalog.WEIGHTS.items()], F.lit(0.0)) / sum(catalog.WEIGHTS.values())
        flagged = F.array_compact(F.array(*[F.when(scores[k] >= self.threshold, k) for k in sorted(self.entries)]))
        return F.struct(
            ((overall >= self.threshold) | (F.size(flagged) > 0)).alias("is_toxic"),
            round4(overall).alias("overall_score"),
            *[round4(scores[k]).alias(k) for k in self.entries],
            flagged.alias("flagged_categories"),
            F.lit(float(self.threshold)).alias("threshold"),
        )

    def classify(self, text: Column) -> Column:
        """:meth:`judged` of :meth:`scores`; a blank or null text is not toxic."""
        return let(self.scores(text), self.judged)
