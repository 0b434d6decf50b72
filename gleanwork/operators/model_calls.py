"""Calls of a text model as an operator: each different request once, answers kept in a cache, failures as rows.

A request is a model's name and its messages; its key is the hash of both. Requests with a
fresh cache entry aren't called. The others are called in ``mapInPandas`` tasks by a function that is given,
several times if it fails, and every attempt is a row. Attempts are written before anything reads
them, so a lost executor repeats the calls of its own tasks only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.operators import drafts
from gleanwork.operators.checkpoints import materialize
from gleanwork.operators.joins import join_by_frequency

CACHE = "key string, at timestamp, value string"
ATTEMPTS = "key string, attempt int, reply string, error string"
#: After so many requests a task hands its replies on.
HANDED_ON = 64


@dataclass(frozen=True)
class Model:
    """What to call and how: ``call(messages, options)`` gives a reply's text or raises.

    ``attempts``: how often at most; after the n-th failure a task waits ``wait`` * 2^n seconds.
    ``lanes``: how many tasks call at once (None: the session's shuffle partitions). ``hours``: how long a cached reply is fresh.
    ``options`` go to the call and are no part of a request's key.
    """

    name: str
    call: Callable[[list[dict], dict], str]
    attempts: int = 3
    wait: float = 0.0
    lanes: int | None = None
    hours: int = 24
    options: tuple[tuple[str, float | int | str | bool], ...] = ()


@dataclass(frozen=True)
class Asked:
    """``answers``: the requests with key, reply, error, n_attempts and from_cache. ``attempts``: every call made. ``cache``: the new snapshot."""

    answers: DataFrame
    attempts: DataFrame
    cache: DataFrame


def messages(system: str | Column, user: Column) -> Column:
    """The usual two: what the model is, and what it is asked."""
    system = F.lit(system) if isinstance(system, str) else system
    pair = [F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content")) for role, text in (("system", system), ("user", user))]
    return F.array(*pair)


def request_key(name: str, asked: Column) -> Column:
    return T.request_hash({"model": F.lit(name), "messages": asked})


def _calls(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def attempts(key: str, asked: str) -> Iterator[tuple]:
        for n in range(1, model.attempts + 1):
            try:
                reply = model.call(json.loads(asked), dict(model.options))
                if not isinstance(reply, str):
                    raise TypeError(f"reply is {type(reply).__name__}, no text")
            except Exception as e:  # whatever a call raises is an answer of its kind: a row
                yield key, n, None, f"{type(e).__name__}: {e}"[:500]
                if n < model.attempts and model.wait:
                    time.sleep(model.wait * 2**n)
            else:
                yield key, n, reply, None
                return

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), HANDED_ON):
                part = frame.iloc[at : at + HANDED_ON]
                rows = [r for key, asked in zip(part["key"], part["asked"], strict=True) for r in attempts(key, asked)]
                yield pd.DataFrame(rows, columns=["key", "attempt", "reply", "error"])

    return run


def ask(requests: DataFrame, model: Model, cache: DataFrame, as_of: Column) -> Asked:
    """Answers for ``requests`` (messages: array of struct(role, content), and other columns).

    Equal requests are called once. A request without messages is one like others; a model that fails
    ``attempts`` times leaves a null reply and the last error, and nothing in the cache.
    """
    keyed = materialize(requests.withColumn("key", request_key(model.name, F.col("messages"))))
    each = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first(F.to_json("messages")).alias("asked"))
    known = drafts.fresh_cache(cache, as_of, model.hours).groupBy(F.col("key").alias("__known")).agg(F.max_by("value", "at").alias("value"))
    told = materialize(each.join(known, F.col("key") == F.col("__known"), "left").drop("__known"))
    waiting = told.where("value IS NULL").select("key", "asked")
    waiting = waiting.repartition("key") if model.lanes is None else waiting.repartition(model.lanes, "key")
    made = materialize(waiting.mapInPandas(_calls(model), ATTEMPTS))
    last = made.groupBy(F.col("key").alias("__called")).agg(F.max_by(F.struct("reply", "error"), "attempt").alias("last"), F.max("attempt").alias("n_attempts"))
    answers = told.join(last, F.col("key") == F.col("__called"), "left").select(
        "key", "n", F.coalesce("value", "last.reply").alias("reply"), F.col("last.error").alias("error"), F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.col("value").isNotNull().alias("from_cache")
    )
    total = keyed.count()
    apart = F.xxhash64(*[c for c in requests.columns if c != "messages"]) if len(requests.columns) > 1 else F.lit(0)
    joined = join_by_frequency(keyed, answers, "key", "n", total, apart)
    fresh = drafts.cached(cache, F.col("key"), F.col("reply"), as_of, made.where("reply IS NOT NULL"))
    return Asked(joined, made, fresh)


def parsed(asked: DataFrame, schema: str, into: str = "value") -> DataFrame:
    """``asked`` with the JSON of each reply as ``schema``; a reply that holds no such object is an error.

    Fields that the reply lacks, or that have another type there, are null.
    """
    found = T.lenient_json(F.col("reply"))
    value = F.from_json(F.to_json(found), schema)
    is_object = F.coalesce(F.schema_of_variant(found).startswith("OBJECT"), F.lit(False))
    error = F.when(F.col("error").isNull() & ~is_object, F.lit("reply holds no JSON object")).otherwise(F.col("error"))
    return asked.withColumn(into, F.when(is_object, value)).withColumn("error", error)
