"""Latency of a stream of events, as a batch query or with Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, key, mean value, count; the same plan runs over a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "mean_value", "n")


def latency_stream(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """For readStream sources: rows later than ``delay`` are dropped, and so is state."""
    return latency_window(_timed(events, delay), width)


def latency_sessions(events: DataFrame, gap: str = "2 hours", quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """session_start, session_end, key, n, mean_value and a quantile of each kind: runs of a user's events no further apart than gap.

    Quantiles come from mergeable sketches, exact for sessions of fewer than 10,000 events; the same plan runs over a
    stream, where a late event may join two sessions into one.
    """
    told = events.groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("key"))
    got = told.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.percentile_approx("value", list(quantiles), 10_000).alias("q"))
    named = [F.col("q")[i].alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)]
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "key", "n", F.round("mean_value", 6).alias("mean_value"), *named)


def sessions_stream(events: DataFrame, delay: str = "10 minutes", gap: str = "2 hours") -> DataFrame:
    """For readStream sources: a session is told once the watermark has passed its end; later rows are dropped."""
    return latency_sessions(_timed(events, delay), gap)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """With a watermark, which takes instants rather than local times."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
