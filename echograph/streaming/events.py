"""Streams: windowed counts of events, and scoring of arriving documents against static sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.operators import features as FG


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark; watermarks need timestamps of a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total; on a stream, state older than the watermark is dropped."""
    rows = _timed(events, late)
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def stream_static_matches(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """unit, source, f: words of arriving units that few sources have; append mode, without state."""
    postings = FG.token_table(sources).select(F.col("unit").alias("source"), F.col("w").alias("f")).distinct()
    rare = postings.groupBy("f").agg(F.count(F.lit(1)).alias("df")).where("df <= 3").select("f")
    return FG.token_table(documents).select("unit", F.col("w").alias("f")).join(postings.join(rare, "f"), "f").select("unit", "source", "f")
