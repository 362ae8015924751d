"""The text operators over streams. An extension: one text at a time needs no state, so the same expressions run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import rules
from glyphmill.functions import text as tx
from glyphmill.operators import findings


def sanitized(stream: DataFrame, mode: str, text_col: str = "text") -> DataFrame:
    """``findings.sanitize_text`` of a stream: stateless, in append mode."""
    return findings.sanitize_text(stream, mode, text_col)


def first_seen(stream: DataFrame, time_col: str, delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """The stream without repeats of a text within ``delay``; the state holds digests only, and old ones go."""
    return stream.withWatermark(time_col, delay).withColumn("sha256", F.sha2(F.col(text_col).cast("binary"), 256)).dropDuplicatesWithinWatermark(["sha256"])


def rates(stream: DataFrame, time_col: str, window: str = "10 minutes", delay: str = "1 hour", text_col: str = "text") -> DataFrame:
    """(window, texts, marked_texts, marks, risk_...): marks by window of event time; late texts count until ``delay``."""
    text = F.col(text_col)
    return (
        stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("window"))
        .agg(
            F.count("*").alias("texts"), F.count_if(text.rlike(rules.ALL_FAST)).alias("marked_texts"), F.sum(tx.finding_count(text)).alias("marks"),
            *[F.sum(tx.severity_count(text, s)).alias(f"risk_{s}") for s in rules.SEVERITIES],
        )
    )
