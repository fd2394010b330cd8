"""Where texts come from and results go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry.api import LONGEST_REQUEST, scan_json


def from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """Rows (id, text) of a list."""
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def from_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row (path, text) per file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def from_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def from_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines with ``text`` and, if given, ``policy_names``, ``strategy``, ``entity_types`` and ``sensitivity``; texts of 1 to 100 000 characters."""
    schema = "text string, policy_names array<string>, strategy string, entity_types array<string>, sensitivity string"
    return spark.read.schema(schema).json(path).where(F.length("text").between(1, LONGEST_REQUEST))


def to_text(df: DataFrame, path: str, column: str = "redaction.redacted_text", mode: str = "error") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def to_json_lines(df: DataFrame, path: str, scan: str = "scan", mode: str = "error") -> None:
    """Scans, one JSON object a line."""
    df.select(scan_json(scan).alias("value")).write.mode(mode).text(path)


def to_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def short(column: str, size: int = 50) -> Column:
    """At most ``size`` characters, then three dots."""
    c = F.col(column)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def detections_table(df: DataFrame, scan: str = "scan", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per detection, texts cut for display."""
    return df.select(*keep, F.inline(f"{scan}.detections")).select(*keep, "entity_type", short("text").alias("text"), F.call_function("format_number", F.col("confidence"), F.lit("0.00")).alias("confidence"), "severity")


def violations_table(df: DataFrame, scan: str = "scan", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per violation."""
    return df.select(*keep, F.inline(f"{scan}.policy_violations")).select(*keep, F.col("rule_name").alias("rule"), F.col("policy_name").alias("policy"), "action", "message")


def to_console(df: DataFrame, scan: str = "scan", rows: int = 20) -> None:
    detections_table(df, scan).show(rows, truncate=False)
    violations_table(df, scan).show(rows, truncate=False)
