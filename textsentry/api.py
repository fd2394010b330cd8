"""The engine: policies and settings on the driver, results as columns of any DataFrame, batch or streaming."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry.catalog import injection, pii
from textsentry.functions.text import text_of
from textsentry.operators.injection import InjectionDetector
from textsentry.operators.redact import redact_pii
from textsentry.plans.compiler import Compiler, Detector, RowFunction
from textsentry.plans.model import BUNDLED, Policy, load_directory, load_file, problems
from textsentry.types import SENSITIVITIES, STRATEGIES, chosen

log = logging.getLogger(__name__)
#: Fixed value: the longest text a request may have.
LONGEST_REQUEST = 100_000


class Engine:
    """Scans, redacts and validates a text column.  Without policies every scan allows."""

    def __init__(self, policy_path: str | Path | None = None, sensitivity: str = "medium", aliases: bool = False):
        self.sensitivity = chosen(sensitivity, SENSITIVITIES, "sensitivity")
        self.policies: list[Policy] = []
        self.compiler = Compiler(sensitivity, aliases)
        if policy_path is not None:
            (self.load_policies if Path(policy_path).is_dir() else self.load_policy)(policy_path)

    def load_policy(self, path: str | Path) -> Policy:
        policy = load_file(path)
        for p in problems(policy):
            log.warning("%s: %s", policy.name, p)
        self.policies.append(policy)
        return policy

    def load_policies(self, path: str | Path = BUNDLED) -> list[Policy]:
        found = load_directory(path)
        self.policies += found
        return found

    def register_detector(self, detector_type: str, detector: Detector) -> None:
        self.compiler.register(detector_type, detector)

    def register_function(self, detector_type: str, function: RowFunction) -> None:
        """See :meth:`Compiler.register_function`."""
        self.compiler.register_function(detector_type, function)

    def scan(self, df: DataFrame, text: str = "text", into: str = "scan") -> DataFrame:
        return self.compiler.scan(df, self.policies, text, into)

    def redact(self, df: DataFrame, strategy: str = "replace", text: str = "text", into: str = "redaction") -> DataFrame:
        chosen(strategy, STRATEGIES, "strategy")
        return df.withColumn(into, redact_pii(F.col(text), strategy))

    def validate_prompt(self, df: DataFrame, text: str = "text", into: str = "injection") -> DataFrame:
        return df.withColumn(into, InjectionDetector(self.sensitivity).detect(text_of(F.col(text))))

    def catalog(self, spark: SparkSession) -> DataFrame:
        """One row per rule of the loaded policies, in order."""
        rows = [(p.name, p.version, p.description, p.default_action, i, r.name, r.detector_type, r.action, r.severity, r.enabled, json.dumps(r.config, sort_keys=True)) for p in self.policies for i, r in enumerate(p.rules)]
        return spark.createDataFrame(rows, "policy string, version string, description string, default_action string, position int, rule string, detector_type string, action string, severity string, enabled boolean, config string")


def pattern_catalog(spark: SparkSession) -> DataFrame:
    """All patterns of personal data and of injection: family, position, name, kind, severity, weight and regex."""
    rows = [("pii", i, p.name, p.entity_type, p.severity, p.confidence, p.regex) for i, p in enumerate(pii.PATTERNS)]
    rows += [("injection", i, p.name, p.category, p.severity, p.weight, p.regex) for i, p in enumerate(injection.PATTERNS)]
    return spark.createDataFrame(rows, "family string, position int, name string, kind string, severity string, weight double, regex string")


def scan_response(scan: str = "scan", metadata: Column | None = None) -> Column:
    """The scan as one JSON string as a service answers: detections with seven keys, violations with five, metadata."""
    s = F.col(scan)
    picked = lambda name, keys: F.transform(s[name], lambda x: F.struct(*[x[k].alias(k) for k in keys])).alias(name)
    found = picked("detections", ("entity_type", "text", "start", "end", "confidence", "detector", "severity"))
    violations = picked("policy_violations", ("rule_name", "policy_name", "severity", "action", "message"))
    extra = F.create_map().cast("map<string,string>") if metadata is None else metadata
    return F.to_json(F.struct(s["is_safe"].alias("is_safe"), s["action"].alias("action"), found, violations, extra.alias("metadata")))


def scan_json(scan: str = "scan") -> Column:
    """The scan as one JSON string: is_safe, action, detections and violations."""
    s = F.col(scan)
    return F.to_json(
        F.struct(
            s["is_safe"].alias("is_safe"),
            s["action"].alias("action"),
            F.transform(s["detections"], lambda d: F.struct(*[d[k].alias(k) for k in ("entity_type", "text", "confidence", "severity")])).alias("detections"),
            F.transform(s["policy_violations"], lambda v: F.struct(v["rule_name"].alias("rule"), v["policy_name"].alias("policy"), v["action"].alias("action"), v["message"].alias("message"))).alias("violations"),
        )
    )
