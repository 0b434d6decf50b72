"""Addresses to responses by a function that is given: few tasks per host, retries as rows, each address once.

The library opens no connection of its own. A landing job gives a function of an address; queries read what it landed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import url as U
from gleanwork.operators.checkpoints import materialize

#: A response: its status and body.
Get = Callable[[str], tuple[int, bytes]]
ATTEMPTS = "host string, url string, attempt int, status int, body binary, error string"
#: After so many addresses a task hands its responses on.
HANDED_ON = 16


def _tried(url: str, get: Get, retries: int, backoff: float) -> Iterator[tuple]:
    for n in range(1, retries + 2):
        status, body, error = None, None, None
        try:
            status, body = get(url)
            error = f"status {status}" if status >= 400 else None
        except Exception as e:  # whatever a request raises is an attempt that failed
            error = f"{type(e).__name__}: {e}"[:500]
        yield n, status, None if error else body, error
        if error is None:
            return
        if n <= retries and backoff:
            time.sleep(backoff * n)


def attempts(urls: DataFrame, get: Get, retries: int = 2, backoff: float = 0.0, lanes: int = 2, landed: DataFrame | None = None) -> DataFrame:
    """(host, url, attempt, status, body, error): every request made for ``urls`` (url), in a table of its own.

    Different addresses once each, those of ``landed`` (url) not at all, nor null and empty ones. A host's addresses go through at most
    ``lanes`` tasks, in order; after its n-th failure an address waits ``backoff`` * n seconds, and is given up after
    ``retries`` more tries. A lost executor repeats the requests of its own tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), HANDED_ON):
                part = frame.iloc[at : at + HANDED_ON]
                rows = [(host, url, *r) for host, url in zip(part["host"], part["url"], strict=True) for r in _tried(url, get, retries, backoff)]
                told = pd.DataFrame(rows, columns=["host", "url", "attempt", "status", "body", "error"])
                yield told.astype({"status": "Int32", "attempt": "int32"})

    wanted = urls.select("url").where(F.coalesce("url", F.lit("")) != "").distinct()
    if landed is not None:
        wanted = wanted.join(landed.select(F.col("url").alias("__landed")).distinct(), F.col("url") == F.col("__landed"), "left_anti")
    placed = wanted.withColumn("host", F.lower(U.host(F.col("url")))).withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)))
    ordered = placed.repartition("host", "lane").sortWithinPartitions("host", "url").select("host", "url")
    return materialize(ordered.mapInPandas(run, ATTEMPTS))


def responses(made: DataFrame) -> DataFrame:
    """(url, status, body, error, n_attempts): how each address ended."""
    last = F.max_by(F.struct("status", "body", "error"), "attempt").alias("last")
    return made.groupBy("url").agg(last, F.max("attempt").alias("n_attempts")).select("url", "last.status", "last.body", "last.error", "n_attempts")
