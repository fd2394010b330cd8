"""Names, ranks and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities and actions from weakest to strongest, and redaction strategies.
SEVERITIES = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "warn", "redact", "deny")
STRATEGIES = ("mask", "hash", "replace", "remove")
#: Confidence from which a sensitivity flags an injection.
SENSITIVITIES = {"low": 0.8, "medium": 0.5, "high": 0.3, "paranoid": 0.1}
DETECTOR_TYPES = ("pii", "injection", "toxicity", "topic", "language", "sentiment", "custom")

DETECTION = "struct<entity_type:string,text:string,start:int,end:int,confidence:double,detector:string,severity:string,pattern_name:string,extra:string>"
VIOLATION = f"struct<rule_name:string,policy_name:string,severity:string,action:string,message:string,detections:array<{DETECTION}>>"
REDACTION = "struct<entity_type:string,original:string,replacement:string,start:int,end:int,strategy:string>"
MATCH = "struct<pattern_name:string,category:string,severity:string,text:string,start:int,end:int,weight:double>"


def chosen(value: str, allowed: tuple[str, ...] | dict, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def rank(names: tuple[str, ...], value: str) -> int:
    return names.index(value)


def label(names: tuple[str, ...], number: Column) -> Column:
    """The name at a rank."""
    return F.element_at(F.array(*map(F.lit, names)), number + 1)


def detection(entity_type: str, text: Column, start: Column, end: Column, confidence: Column, detector: str, severity: Column, pattern_name: Column | None = None, extra: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(entity_type).alias("entity_type"),
        text.alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        confidence.cast("double").alias("confidence"),
        F.lit(detector).alias("detector"),
        severity.alias("severity"),
        (null if pattern_name is None else pattern_name).alias("pattern_name"),
        (null if extra is None else extra).alias("extra"),
    )


def no_detections() -> Column:
    return F.array().cast(f"array<{DETECTION}>")
