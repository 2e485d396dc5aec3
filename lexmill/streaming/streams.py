"""Structured Streaming: scans and redaction work unchanged; copies are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import pii


def redacted(stream: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, text) of a stream of texts with placeholders for contact data."""
    scanned = pii.scan(stream, key=key, text=text)
    return scanned.select(key, pii.redact(F.col(text), F.col("found")).alias(text))


def first_copies(stream: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """The first row of each text that arrives within the delay; later state is forgotten."""
    keyed = stream.withWatermark(time, delay).withColumn("__h", F.sha2(F.col(text), 256))
    return keyed.dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def mentions_per_window(stream: DataFrame, time: str, delay: str, width: str, skill: str = "skill_id") -> DataFrame:
    """Skill mentions in windows of event time; late rows count until the watermark passes."""
    kept = stream.where(F.col(skill).isNotNull()).withWatermark(time, delay)
    return kept.groupBy(F.window(time, width), skill).agg(F.count("*").alias("n"))
