"""SQL functions and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textsentry.api import Engine

_FUNCTIONS = {
    "ts_strip": ("x STRING", "STRING", r"regexp_replace(x, '(?U)^\\s+|\\s+\\z', '')"),
    "ts_digits": ("x STRING", "STRING", r"regexp_replace(x, '(?U)\\D', '')"),
    "ts_luhn": ("x STRING", "BOOLEAN", r"length(regexp_replace(x, '(?U)\\D', '')) >= 2 AND luhn_check(regexp_replace(x, '(?U)\\D', ''))"),
    "ts_mask": ("x STRING", "STRING", "repeat('*', length(x))"),
    "ts_hash": ("x STRING", "STRING", "concat('[', substring(sha2(x, 256), 1, 8), ']')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions; Catalyst inlines them."""
    for name, (args, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_FUNCTIONS)


def register_scan(df: DataFrame, engine: Engine, name: str, text: str = "text") -> None:
    """Views ``name`` (rows with their scan), ``name_detections`` and ``name_violations`` (one row each)."""
    out = engine.scan(df, text)
    out.createOrReplaceTempView(name)
    spark = df.sparkSession
    keep = ", ".join(f"`{c}`" for c in df.columns if c != text)
    for part, column in (("detections", "detections"), ("violations", "policy_violations")):
        spark.sql(f"SELECT {keep}, d.* FROM {name} LATERAL VIEW explode(scan.{column}) AS d").createOrReplaceTempView(f"{name}_{part}")
