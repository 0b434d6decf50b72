"""Streaming twins of batch operators: freshness, duplicates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import url as U


def fresh(stream: DataFrame, at: str, since: Column) -> DataFrame:
    """Items at or after ``since``; in a stream the look-back is a fixed bound, not the clock."""
    return stream.where(F.col(at) >= since)


def first_of(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark, which bounds the state; ``at`` is a timestamp."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def first_of_url(stream: DataFrame, url: Column, at: str, delay: str) -> DataFrame:
    """The first item of each canonical URL within the watermark; ``at`` is a timestamp."""
    return first_of(stream.withColumn("canonical", U.canonical_url(url)), ["canonical"], at, delay)


def feed_counts(stream: DataFrame, feed: str, at: str, window: str, delay: str, kept: Column) -> DataFrame:
    """Seen and kept per feed and window."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, window), feed)
    return grouped.agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"))
