"""Detection of prompt injection: patterns combined as noisy-or, and a semantic score."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog import injection as catalog
from textsentry.catalog.injection import InjectionPattern
from textsentry.functions.text import blank, count_matches, count_of, has, joined, let, round4, rx, spans, strip, text_of
from textsentry.types import MATCH, SENSITIVITIES, SEVERITIES, chosen, label


class InjectionDetector:
    def __init__(self, sensitivity: str = "medium", patterns: Iterable[InjectionPattern] | None = None, semantic_weight: float = 0.3):
        if not 0 <= semantic_weight <= 1:
            raise ValueError("semantic_weight must lie in [0, 1]")
        self.sensitivity = sensitivity
        self.patterns = list(patterns or catalog.PATTERNS)
        self.semantic_weight = semantic_weight

    @property
    def sensitivity(self) -> str:
        return self._sensitivity

    @sensitivity.setter
    def sensitivity(self, value: str) -> None:
        self._sensitivity = chosen(value, SENSITIVITIES, "sensitivity")

    @property
    def threshold(self) -> float:
        return SENSITIVITIES[self.sensitivity]

    def flags(self, text: Column) -> dict[str, Column]:
        """Whether each pattern is found, by name; of patterns with one name any counts."""
        out: dict[str, Column] = {}
        for p in self.patterns:
            hit = has(text, p.regex, p.flags)
            out[p.name] = out[p.name] | hit if p.name in out else hit
        return out

    def pattern_confidence(self, text: Column) -> Column:
        """1 less the product of (1 - weight) over the names found, each with its greatest weight."""
        by_name: dict[str, list[InjectionPattern]] = {}
        for p in self.patterns:
            by_name.setdefault(p.name, []).append(p)
        miss = F.lit(1.0)
        for same in by_name.values():
            factor = F.lit(1.0)
            for p in sorted(same, key=lambda p: p.weight):
                factor = F.when(has(text, p.regex, p.flags), 1.0 - p.weight).otherwise(factor)
            miss = miss * factor
        return round4(1.0 - miss)

    def severity(self, text: Column) -> Column:
        """The gravest of the patterns found, else low."""
        ranks = [F.when(has(text, p.regex, p.flags), SEVERITIES.index(p.severity)).otherwise(0) for p in self.patterns]
        return label(SEVERITIES, F.greatest(*ranks, F.lit(0)))

    def matches(self, text: Column) -> Column:
        """All matches, by pattern."""
        return joined([_matches(text, p) for p in self.patterns])

    def score(self, text: Column) -> Column:
        """struct(is_injection, confidence, pattern_confidence, semantic_confidence), without matches: searches alone.

        A blank or null text is not flagged and scores 0.
        """
        text = text_of(text)
        parts = F.struct(self.pattern_confidence(text).alias("pattern"), semantic_scores(text)["overall"].alias("semantic"), blank(text).alias("blank"))
        return let(parts, lambda p: self._combined(p["pattern"], p["semantic"], p["blank"]))

    def _combined(self, pattern: Column, semantic: Column, zero: Column) -> Column:
        both = round4(F.least(pattern * (1.0 - self.semantic_weight) + semantic * self.semantic_weight, F.lit(1.0)))
        return F.struct(
            F.when(zero, False).otherwise(both >= self.threshold).alias("is_injection"),
            F.when(zero, 0.0).otherwise(both).alias("confidence"),
            F.when(zero, 0.0).otherwise(pattern).alias("pattern_confidence"),
            F.when(zero, 0.0).otherwise(semantic).alias("semantic_confidence"),
        )

    def detect(self, text: Column) -> Column:
        """The score with severity, matches, semantic scores and their signals, what was matched, and the reason if nothing was looked at."""
        text = text_of(text)
        parts = {"score": self.score(text), "found": self.matches(text), "semantic": semantic_scores(text), "severity": self.severity(text), "signals": signals(text), "blank": blank(text)}
        return let(F.struct(*[c.alias(k) for k, c in parts.items()]), self._result)

    @staticmethod
    def _result(p: Column) -> Column:
        score, found, semantic, zero = p["score"], p["found"], p["semantic"], p["blank"]
        names = F.array_distinct(F.transform(found, lambda m: m["pattern_name"]))
        none = lambda c: F.when(zero, 0.0).otherwise(c)
        return F.struct(
            *[score[k].alias(k) for k in ("is_injection", "confidence", "pattern_confidence", "semantic_confidence")],
            F.when(zero, "low").otherwise(p["severity"]).alias("severity"),
            found.alias("matched_patterns"),
            *[none(semantic[k]).alias(k) for k in catalog.SEMANTIC_WEIGHTS],
            p["signals"].alias("signals"),
            F.size(found).alias("pattern_match_count"),
            F.size(names).alias("unique_patterns_matched"),
            names.alias("patterns_matched"),
            F.array_sort(F.array_distinct(F.transform(found, lambda m: m["category"]))).alias("categories_detected"),
            F.when(zero, "empty_input").alias("reason"),
        )


def _matches(text: Column, p: InjectionPattern) -> Column:
    def match(s: Column) -> Column:
        return F.struct(F.lit(p.name).alias("pattern_name"), F.lit(p.category).alias("category"), F.lit(p.severity).alias("severity"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.lit(p.weight).alias("weight")).cast(MATCH)

    return F.transform(spans(text, p.regex, p.flags), match)


def sentences(text: Column) -> Column:
    """Parts after ``.!?`` and white space, or at line breaks, without blanks around; empty ones are left out."""
    return F.filter(F.transform(F.split(strip(text), rx(r"(?<=[.!?])\s+|\n+")), strip), lambda s: s != "")


def _imperatives(text: Column) -> tuple[Column, Column]:
    parts = sentences(text)
    return F.size(F.filter(parts, lambda s: has(s, catalog.IMPERATIVE, "im"))), F.greatest(F.size(parts), F.lit(1))


def _padded(text: Column) -> Column:
    lines = count_of(text, "\n")
    return (lines > 20) & (F.length(strip(text)) < lines * 5)


def _counts(text: Column) -> Column:
    count, total = _imperatives(text)
    numbers = {"count": count, "total": total, **{k: count_matches(text, r, "i") for k, r in (("directives", catalog.DIRECTIVE), ("roles", catalog.ROLEPLAY), ("bounds", catalog.BOUNDARY))}}
    flags = {"addressed": has(text, catalog.ADDRESSAL, "i"), "urgent": has(text, catalog.URGENCY, "i"), "meta": has(text, catalog.META, "i"), "padded": _padded(text)}
    return F.struct(*[c.alias(k) for k, c in (numbers | flags).items()])


def semantic_scores(text: Column) -> Column:
    """struct(imperative, roleplay, context_manipulation, overall), each rounded; overall is of the unrounded scores."""
    return let(let(_counts(text), _unrounded), _weighted)


def _unrounded(c: Column) -> Column:
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    cap = lambda c, most=1.0: F.least(c, F.lit(most))
    # fixed values: weights and caps
    scores = {
        "imperative": cap(when(c["count"] > 0, cap(c["count"] / c["total"] * 1.5, 0.5)) + when(c["directives"] > 0, cap(c["directives"] * 0.15, 0.3)) + when(c["addressed"], 0.2) + when(c["urgent"], 0.1)),
        "roleplay": cap(when(c["roles"] > 0, cap(c["roles"] * 0.35, 0.7)) + when(c["addressed"] & (c["roles"] > 0), 0.3)),
        "context_manipulation": cap(when(c["bounds"] > 0, cap(c["bounds"] * 0.2, 0.4)) + when(c["meta"], 0.4) + when(c["padded"], 0.2)),
    }
    return F.struct(*[x.alias(k) for k, x in scores.items()])


def _weighted(s: Column) -> Column:
    overall = reduce(lambda a, b: a + b, [s[k] * w for k, w in catalog.SEMANTIC_WEIGHTS.items()])
    return F.struct(*[round4(s[k]).alias(k) for k in catalog.SEMANTIC_WEIGHTS], round4(F.least(overall, F.lit(1.0))).alias("overall"))


def signals(text: Column) -> Column:
    """What the semantic score rests on, in words."""
    return let(_counts(text), _signals)


def _signals(c: Column) -> Column:
    # fixed values: the sentences of the signals
    some = lambda k, form: F.when(c[k] > 0, F.format_string(form, c[k]))
    found = [
        F.when(c["count"] > 0, F.format_string("Imperative verb ratio: %d/%d sentences", c["count"], c["total"])),
        some("directives", "Second-person directives detected (%d occurrences)"),
        F.when(c["addressed"], "Direct AI addressal detected"),
        F.when(c["urgent"], "Urgency language detected"),
        some("roles", "Role manipulation phrases detected (%d occurrences)"),
        F.when(c["addressed"] & (c["roles"] > 0), "Role manipulation combined with AI addressal"),
        some("bounds", "Context boundary markers detected (%d occurrences)"),
        F.when(c["meta"], "Meta-instruction language detected"),
        F.when(c["padded"], "Suspicious whitespace padding detected"),
    ]
    return F.array_compact(F.array(*found))
