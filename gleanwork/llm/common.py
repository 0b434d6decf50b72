"""Helpers shared by the training-data operators: word expressions, hashes and the library's scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.operators.checkpoints import materialize, narrow_result
from gleanwork.operators.joins import join_by_frequency

__all__ = ["crc_bucket", "documents", "join_by_frequency", "materialize", "narrow_result", "release_memory", "small_batches", "unit_hash", "word_count"]

#: What stands between the words of the near-duplicate and mixing operators: ASCII white space.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: workers are reused, and what one stage held would stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While this is open, jobs hand Python workers at most so many bytes of rows at once: long texts and sets come one by one, short ones together."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column, between: str = BETWEEN_WORDS) -> Column:
    """How many words a text has (null: 0); splitting between words is many times faster than matching them."""
    return F.coalesce(F.size(F.filter(F.split(text, between), lambda w: w != "")), F.lit(0)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: 32 bits of MD5, which SQL engines share."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(4294967296.0)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null key: the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
