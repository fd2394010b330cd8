"""Optional back-ends for named entities, and the registry of detectors.

The models run in Arrow batches, loaded once per worker.  Where their packages
are not installed the detectors find nothing.
"""

from __future__ import annotations

import importlib.util
import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.catalog import pii as catalog
from textsentry.functions.text import joined, text_of
from textsentry.operators.pii import PIIDetector
from textsentry.types import DETECTION, no_detections

log = logging.getLogger(__name__)


def _installed(package: str) -> bool:
    return importlib.util.find_spec(package) is not None


def _batched(load: Callable[[], Callable[[str], list[dict]]]) -> Callable[[Column], Column]:
    @F.pandas_udf(f"array<{DETECTION}>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = load()
        for texts in batches:
            yield texts.map(detect)

    return found


class NERDetector:
    name = "spacy_ner"

    def __init__(self, model: str = "en_core_web_sm", entity_types: Iterable[str] | None = None, confidences: dict[str, float] | None = None):
        self.model, self.entity_types = model, None if entity_types is None else set(entity_types)
        self.confidences = catalog.NER_CONFIDENCES | (confidences or {})

    @property
    def is_available(self) -> bool:
        return _installed("spacy") and _installed(self.model)

    def detect(self, text: Column) -> Column:
        if not self.is_available:
            return no_detections()
        model, wanted, sure = self.model, self.entity_types, self.confidences

        def load() -> Callable[[str], list[dict]]:
            import spacy

            nlp = spacy.load(model)

            def detect(value: str) -> list[dict]:
                out = []
                for e in nlp(value).ents:
                    kind = catalog.NER_TYPES.get(e.label_)
                    if kind and (wanted is None or kind in wanted):
                        out.append({"entity_type": kind, "text": e.text, "start": e.start_char, "end": e.end_char, "confidence": sure.get(e.label_, 0.7), "detector": "spacy_ner", "severity": catalog.NER_SEVERITIES.get(kind, "medium"), "pattern_name": None, "extra": None})
                return out

            return detect

        return _batched(load)(text_of(text))


class AnalyzerDetector:
    name = "presidio"

    def __init__(self, language: str = "en", entities: Iterable[str] | None = None, threshold: float = 0.4):
        self.language, self.entities, self.threshold = language, None if entities is None else list(entities), threshold

    @property
    def is_available(self) -> bool:
        return _installed("presidio_analyzer")

    def detect(self, text: Column) -> Column:
        if not self.is_available:
            return no_detections()
        language, entities, threshold = self.language, self.entities, self.threshold

        def load() -> Callable[[str], list[dict]]:
            from presidio_analyzer import AnalyzerEngine

            engine = AnalyzerEngine()

            def detect(value: str) -> list[dict]:
                out = []
                for r in engine.analyze(text=value, language=language, entities=entities, score_threshold=threshold):
                    kind = catalog.ANALYZER_TYPES.get(r.entity_type, r.entity_type)
                    out.append({"entity_type": kind, "text": value[r.start : r.end], "start": r.start, "end": r.end, "confidence": r.score, "detector": "presidio", "severity": catalog.ANALYZER_SEVERITIES.get(kind, "medium"), "pattern_name": None, "extra": None})
                return out

            return detect

        return _batched(load)(text_of(text))


@dataclass
class _Entry:
    detector: object
    enabled: bool
    priority: int


class DetectorRegistry:
    """Detectors by name: anything with ``detect(Column) -> Column`` of detections."""

    def __init__(self, builtins: bool = True):
        self._entries: dict[str, _Entry] = {}
        if builtins:
            self.register("regex", PIIDetector(), True, 10)
            self.register("spacy_ner", NERDetector(), False, 20)
            self.register("presidio", AnalyzerDetector(), False, 30)

    def register(self, name: str, detector: object, enabled: bool = True, priority: int = 50) -> None:
        self._entries[name] = _Entry(detector, enabled, priority)

    def unregister(self, name: str) -> None:
        self._get(name)
        del self._entries[name]

    def enable(self, name: str) -> None:
        self._get(name).enabled = True

    def disable(self, name: str) -> None:
        self._get(name).enabled = False

    def is_enabled(self, name: str) -> bool:
        return self._get(name).enabled

    def get(self, name: str) -> object:
        return self._get(name).detector

    def active(self) -> list[tuple[str, object]]:
        return [(k, e.detector) for k, e in sorted(self._entries.items(), key=lambda x: x[1].priority) if e.enabled]

    def listing(self) -> list[dict]:
        return [{"name": k, "enabled": e.enabled, "priority": e.priority} for k, e in sorted(self._entries.items(), key=lambda x: x[1].priority)]

    def detect_all(self, text: Column) -> Column:
        """Detections of all active detectors by start, then priority; overlaps stay.  One whose expression cannot be built is logged and left out."""
        parts = []
        for name, detector in self.active():
            try:
                parts.append(detector.detect(text))
            except Exception:
                log.exception("detector %s failed", name)
        if not parts:
            return no_detections()
        order = F.array_sort(F.transform(joined(parts), lambda d, i: F.struct(d["start"].alias("start"), i.alias("i"), d.alias("d"))))
        return F.transform(order, lambda x: x["d"])

    def _get(self, name: str) -> _Entry:
        if name not in self._entries:
            raise KeyError(name)
        return self._entries[name]
