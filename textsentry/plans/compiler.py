"""Policies compiled to columns: one projection, no shuffle."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.functions.text import joined, text_of
from textsentry.operators.injection import InjectionDetector
from textsentry.operators.language import LanguageDetector
from textsentry.operators.pii import PIIDetector, raw
from textsentry.operators.sentiment import SentimentAnalyzer
from textsentry.operators.topic import TopicClassifier
from textsentry.operators.toxicity import ToxicityClassifier
from textsentry.plans.model import Policy, Rule
from textsentry.types import ACTIONS, DETECTION, VIOLATION, detection, label, no_detections

log = logging.getLogger(__name__)
Detector = Callable[[Column, dict[str, Any]], Column]
RowFunction = Callable[[str, dict[str, Any]], list[dict[str, Any]]]
_KEYS = [f.split(":")[0] for f in DETECTION[7:-1].split(",")]

#: What the names in policies stand for, if aliases are asked for.
ALIASES = {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "PERSON": "PERSON_NAME"}


def _isolated(function: RowFunction, text: str, config: dict[str, Any], name: str) -> list[dict[str, Any]]:
    try:
        return [{k: d.get(k) for k in _KEYS} for d in function(text, config)]
    except Exception:
        log.exception("detector %s failed at a text", name)
        return []


def _when(fires: Column, found: Column) -> Column:
    return F.when(fires, F.array(found)).otherwise(no_detections())


def _whole(entity_type: str, text: Column, confidence: Column, detector: str, severity: str | Column, extra: Column | None = None) -> Column:
    return detection(entity_type, text, F.lit(0), F.length(text), confidence, detector, F.lit(severity) if isinstance(severity, str) else severity, None, extra)


class Shared:
    """Expressions that several rules rest on, computed once a row: raw matches of a pattern, scores before thresholds."""

    def __init__(self) -> None:
        self.columns: dict[str, Column] = {}

    def __call__(self, name: str, build: Callable[[], Column]) -> Column:
        if name not in self.columns:
            self.columns[name] = build()
        return F.col(name)


class Compiler:
    """``sensitivity``: of injection rules that name none.  ``aliases``: let EMAIL stand for EMAIL_ADDRESS and the like."""

    def __init__(self, sensitivity: str = "medium", aliases: bool = False):
        self.sensitivity, self.aliases = sensitivity, aliases
        self.builtin = {"pii": self._pii, "injection": self._injection, "toxicity": self._toxicity, "topic": self._topic, "language": self._language, "sentiment": self._sentiment}
        self.custom: dict[str, Detector] = {}

    def register(self, detector_type: str, detector: Detector) -> None:
        """A detector takes the text column and a rule's config and returns an array of detections; it replaces an earlier or built-in one."""
        self.custom[detector_type] = detector

    def register_function(self, detector_type: str, function: RowFunction) -> None:
        """A Python function that takes a text and a rule's config and returns detections as dicts; keys left out are null.

        It runs in Arrow batches.  A text at which it fails has no detections;
        the failure is logged by the worker and stops neither the other texts
        nor the other rules.
        """

        def detect(text: Column, config: dict[str, Any]) -> Column:
            def each(texts: pd.Series) -> pd.Series:
                return pd.Series([_isolated(function, t, config, detector_type) for t in texts])

            return F.pandas_udf(each, f"array<{DETECTION}>")(text)

        self.register(detector_type, detect)

    def has(self, detector_type: str) -> bool:
        return detector_type in self.custom or detector_type in self.builtin

    def _pii(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        types = config.get("entity_types")
        if types and self.aliases:
            types = [ALIASES.get(t, t) for t in types]
        detector = PIIDetector(enabled=types or None, min_confidence=config.get("min_confidence", 0.0))
        place = {p.name: i for i, p in enumerate(detector.all)}
        return detector.of([shared(f"__pii_{p.name}", lambda p=p: raw(text, p, place[p.name])) for p in detector.patterns])

    def _injection(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        detector = InjectionDetector(config.get("sensitivity", self.sensitivity))
        r = shared("__injection", lambda: F.struct(detector.score(text)["confidence"].alias("confidence"), detector.severity(text).alias("severity")))
        fires = r["confidence"] >= max(detector.threshold, config.get("min_confidence", 0.0))
        return _when(fires, _whole("PROMPT_INJECTION", text, r["confidence"], "injection", r["severity"]))

    def _toxicity(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        classifier = ToxicityClassifier(config.get("threshold", 0.5))
        r = classifier.judged(shared("__toxicity", lambda: classifier.scores(text)))
        return _when(r["is_toxic"], _whole("TOXICITY", text, r["overall_score"], "toxicity", "high", F.to_json(F.struct(r["flagged_categories"].alias("flagged_categories")))))

    def _topic(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        detected = shared("__topic", lambda: TopicClassifier().classify(text)["detected_topics"])
        r = TopicClassifier.judged(detected, config.get("allowed_topics"))
        return _when(~r["is_on_topic"], _whole("OFF_TOPIC", text, r["confidence"], "topic", "medium", F.to_json(F.struct(detected.alias("detected_topics")))))

    def _language(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        detector = LanguageDetector(config.get("allowed_languages"))
        r = shared("__language", lambda: detector.detect(text))
        return _when(~detector.accepts(r["language"]), _whole("DISALLOWED_LANGUAGE", text, r["confidence"], "language", "low", F.to_json(F.struct(r["language"].alias("detected_language")))))

    def _sentiment(self, text: Column, config: dict[str, Any], shared: Shared) -> Column:
        if not config.get("flag_negative", False):
            return no_detections()
        r = shared("__sentiment", lambda: SentimentAnalyzer().analyze(text))
        return _when(r["score"] <= config.get("min_score", -0.7), _whole("NEGATIVE_SENTIMENT", text, r["confidence"], "sentiment", "medium", F.to_json(F.struct(r["sentiment"].alias("sentiment"), r["score"].alias("score")))))

    def detections(self, text: Column, rule: Rule, shared: Shared) -> Column:
        """A rule's detections; none where its type has no detector or the expression cannot be built, which is logged."""
        if not self.has(rule.detector_type):
            log.warning("no detector for %s (rule %s)", rule.detector_type, rule.name)
            return no_detections()
        try:
            if rule.detector_type in self.custom:
                return self.custom[rule.detector_type](text, rule.config)
            return self.builtin[rule.detector_type](text, rule.config, shared)
        except Exception:
            log.exception("rule %s left out", rule.name)
            return no_detections()

    def scan(self, df: DataFrame, policies: list[Policy], text: str = "text", into: str = "scan") -> DataFrame:
        """``df`` with ``into``: struct(action, is_safe, has_warnings, detections, policy_violations).

        Rules that ask for the same share one computation.  A policy starts at
        its default action and escalates; several policies are merged from
        allow on.  Rules named in the chain of a rule that fires run once
        more, after all others, and so are reported twice.
        """
        body = text_of(F.col(text))
        columns: dict[str, str] = {}
        rules: dict[str, Column] = {}
        shared, names = Shared(), df.columns
        for rule in [r for p in policies for r in p.enabled_rules]:
            key = json.dumps([rule.detector_type, rule.config], sort_keys=True, default=str)
            if key not in columns:
                columns[key] = f"__rule{len(columns)}"
                rules[columns[key]] = self.detections(body, rule, shared)
        wide = df.withColumns(shared.columns) if shared.columns else df
        wide = wide.withColumns(rules) if rules else wide
        merged = {f"__policy{i}": self._policy(p, columns) for i, p in enumerate(policies)}
        wide = wide.withColumns(merged) if merged else wide
        results = [F.col(c) for c in merged]
        if results:
            action = label(ACTIONS, F.greatest(*[r["rank"] for r in results], F.lit(0)))
            found, violations = joined([r["detections"] for r in results]), joined([r["violations"] for r in results])
        else:
            action, found, violations = F.lit("allow"), no_detections(), F.array().cast(f"array<{VIOLATION}>")
        wide = wide.withColumns({"__action": action, "__found": found, "__violations": violations})
        a, v = F.col("__action"), F.col("__violations")
        scan = F.struct(a.alias("action"), (a != "deny").alias("is_safe"), ((a == "warn") | (F.size(v) > 0)).alias("has_warnings"), F.col("__found").alias("detections"), v.alias("policy_violations"))
        return wide.withColumn(into, scan).select(*[n for n in names if n != into], into)

    def _policy(self, p: Policy, columns: dict[str, str]) -> Column:
        """struct(rank of the action, detections, violations) of one policy, over the rules' columns."""
        of = lambda r: F.col(columns[json.dumps([r.detector_type, r.config], sort_keys=True, default=str)])
        first = ACTIONS.index(p.default_action)

        def entry(r: Rule, order: Column) -> Column:
            found = of(r)
            message = F.format_string(f"Rule '{r.name}' triggered: %d detection(s) with action={r.action}.".replace("%d", "\0").replace("%", "%%").replace("\0", "%d"), F.size(found))
            violation = F.struct(F.lit(r.name).alias("rule_name"), F.lit(p.name).alias("policy_name"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"), message.alias("message"), found.alias("detections")).cast(VIOLATION)
            return F.struct(order.alias("order"), F.lit(ACTIONS.index(r.action)).alias("rank"), (F.size(found) > 0).alias("fired"), violation.alias("violation"))

        entries = [entry(r, F.lit(i)) for i, r in enumerate(p.enabled_rules)]
        parents: dict[str, list[tuple[int, Rule]]] = {}
        links = [(r, c) for r in p.enabled_rules for c in r.chain]
        for k, (r, c) in enumerate(links, len(p.enabled_rules)):
            parents.setdefault(c, []).append((k, r))
        for name, after in parents.items():
            chained = p.rule(name)
            if chained is None or not chained.enabled:
                log.warning("chained rule %s not found or disabled", name)
                continue
            order = F.least(*[F.when(F.size(of(r)) > 0, k) for k, r in after], F.lit(None).cast("int"))
            entries.append(entry(chained, order))
        if not entries:
            return F.struct(F.lit(first).alias("rank"), no_detections().alias("detections"), F.array().cast(f"array<{VIOLATION}>").alias("violations"))
        fired = F.filter(F.array(*entries), lambda e: e["fired"] & e["order"].isNotNull())
        fired = F.array_sort(F.transform(fired, lambda e, i: F.struct(e["order"].alias("order"), i.alias("i"), e["rank"].alias("rank"), e["violation"].alias("violation")))) if parents else fired
        return F.struct(
            F.aggregate(fired, F.lit(first), lambda a, e: F.greatest(a, e["rank"])).alias("rank"),
            F.flatten(F.transform(fired, lambda e: e["violation"]["detections"])).alias("detections"),
            F.transform(fired, lambda e: e["violation"]).alias("violations"),
        )
