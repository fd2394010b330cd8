"""Detection of personal data: patterns, validators, and removal of overlaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog.pii import PATTERNS, PIIPattern
from textsentry.functions.text import clusters, joined, let, spans, text_of
from textsentry.functions.validators import VALIDATORS
from textsentry.types import DETECTION


class PIIDetector:
    """Chooses patterns at plan time and builds the expression of their detections.

    ``disabled`` wins over ``enabled``; ``min_confidence`` drops patterns
    before matching, so it also changes which overlaps there are.  An empty
    list of patterns stands for all.
    """

    name = "regex"

    def __init__(self, patterns: Iterable[PIIPattern] | None = None, enabled: Iterable[str] | None = None, disabled: Iterable[str] | None = None, min_confidence: float = 0.0):
        self.all = list(patterns or PATTERNS)
        self.enabled = None if enabled is None else set(enabled)
        self.disabled = set(disabled or ())
        self.min_confidence = min_confidence

    def enable(self, entity_type: str) -> None:
        self.disabled.discard(entity_type)
        if self.enabled is not None:
            self.enabled.add(entity_type)

    def disable(self, entity_type: str) -> None:
        self.disabled.add(entity_type)
        if self.enabled is not None:
            self.enabled.discard(entity_type)

    @property
    def patterns(self) -> list[PIIPattern]:
        return [p for p in self.all if (self.enabled is None or p.entity_type in self.enabled) and p.entity_type not in self.disabled and p.confidence >= self.min_confidence]

    def detect(self, text: Column) -> Column:
        """Detections without overlaps, by start.  A null text has none."""
        return self.of([raw(text_of(text), p, i) for i, p in enumerate(self.patterns)])

    @staticmethod
    def of(found: list[Column]) -> Column:
        """Detections from the patterns' own (:func:`raw`)."""
        return without_overlaps(joined(found)) if found else F.array().cast(f"array<{DETECTION}>")


def raw(text: Column, p: PIIPattern, number: int) -> Column:
    """Detections of one pattern, led by what they are sorted by."""
    found = spans(text, p.regex, p.flags)
    if p.validator:
        good = VALIDATORS[p.validator] if isinstance(p.validator, str) else p.validator
        found = F.filter(found, lambda s: F.coalesce(good(s["text"]), F.lit(False)))
    return F.transform(found, lambda s: _keyed(F.lit(p.entity_type), s["text"], s["start"], s["end"], F.lit(p.confidence), F.lit("regex"), F.lit(p.severity), F.lit(p.name), F.lit(number)))


def _keyed(entity_type: Column, text: Column, start: Column, end: Column, confidence: Column, detector: Column, severity: Column, pattern: Column, number: Column) -> Column:
    return F.struct(start.alias("start"), (-confidence).alias("less"), number.alias("number"), end.alias("end"), entity_type.alias("entity_type"), text.alias("text"), confidence.alias("confidence"), detector.alias("detector"), severity.alias("severity"), pattern.alias("pattern_name"))


def keyed(detections: Column) -> Column:
    """An array of detections, given the sort key of :func:`without_overlaps`; equals keep their order."""
    return F.transform(detections, lambda d, i: _keyed(d["entity_type"], d["text"], d["start"], d["end"], d["confidence"], d["detector"], d["severity"], d["pattern_name"], i))


def without_overlaps(found: Column) -> Column:
    """Walks through the spans by start; one that overlaps the last kept replaces it only if it is more confident.

    The walk goes through runs of spans that touch each other; runs are
    independent.
    """

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        more = F.when(x["confidence"] > last["confidence"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)
        return F.when((F.size(kept) > 0) & (x["start"] < last["end"]), more).otherwise(F.concat(kept, F.array(x)))

    def walk(f: Column) -> Column:
        return F.flatten(F.transform(clusters(F.array_sort(f)), lambda c: F.when(F.size(c) > 1, F.aggregate(c, F.slice(c, 1, 0), step)).otherwise(c)))

    kept = let(found, lambda f: F.when(F.size(f) > 1, walk(f)).otherwise(f))
    return F.transform(kept, _plain)


def _plain(d: Column) -> Column:
    names = ("entity_type", "text", "start", "end", "confidence", "detector", "severity", "pattern_name")
    return F.struct(*[d[n].alias(n) for n in names], F.lit(None).cast("string").alias("extra")).cast(DETECTION)
