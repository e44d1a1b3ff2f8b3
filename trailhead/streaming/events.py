"""Event contracts on streams: one row for each identity within a watermark, windows, late versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, delay: str = "10 minutes", at: str = "ingested_at") -> DataFrame:
    """The first row of each (event_id, payload_checksum) within the watermark.

    Another payload of a known id stays, as a version of its own; conflicts() counts those.
    """
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id", "payload_checksum"])


def conflicts(events: DataFrame) -> DataFrame:
    """Ids with more than one payload, exactly, and about how many (2 at least)."""
    differ = F.min("payload_checksum") != F.max("payload_checksum")
    versions = F.greatest(F.approx_count_distinct("payload_checksum"), F.lit(2).cast("long"))
    return events.groupBy("event_id").agg(versions.alias("versions"), differ.alias("_differ")).where("_differ").drop("_differ")


def window_counts(events: DataFrame, at: str, size: str = "1 hour", slide: str | None = None, delay: str | None = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events in half-open windows: window_start, window_end, keys, n_events. Later than the delay is rejected.

    Without a delay, the watermark that the events already have holds.
    """
    w = F.window(at, size, slide) if slide else F.window(at, size)
    counted = (events.withWatermark(at, delay) if delay else events).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n_events"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n_events")


def sessions(events: DataFrame, at: str, gap: str = "30 minutes", delay: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of events without a longer gap: session_start, session_end, keys, n_events."""
    counted = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n_events"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n_events")


def late_version(known: DataFrame, late: DataFrame, key: str = "source_id", version: str = "version") -> DataFrame:
    """Late rows as new versions of their source: the highest known version plus one; unknown sources begin at 1."""
    top = known.groupBy(key).agg(F.max(version).alias("top"))
    return late.join(top, key, "left").withColumn(version, F.coalesce("top", F.lit(0)) + 1).drop("top")
