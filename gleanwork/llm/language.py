"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of every labelled text into buckets per language
inside the tasks, sums those tables in Spark and turns them into one binary row per
language; nothing is sampled. The model, languages x buckets log-probabilities, has a size that
does not depend on the corpus and is broadcast. Scoring takes texts in batches: their
letters are concatenated, all n-grams hashed at once, and for each language the gathered
log-probabilities are summed per text.

Nulls and edge cases: a null text or one without a letter is ``und`` with score 0;
rows with a null language teach nothing; letters are lower-cased and everything else
becomes one kind of gap; texts of any length are read whole, in pieces of bounded
size that share no n-gram; ties go to the language first by code point; without any
training row all documents are ``und``; with more than 512 languages each has fewer
buckets, so that the matrix keeps its size; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import crc_bucket, documents, release_memory

BITS, LEAST_BITS = 15, 6
#: Entries of the matrix, and so of what is broadcast, up to 2**18 languages.
ENTRIES = 1 << 24
#: Letters that are scored or counted at once.
PIECE = 1 << 16
N = 3
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageModel:
    """Languages by code point; log-probabilities (languages, buckets) of n-grams, and of the languages."""

    langs: list[str]
    bits: int
    grams: np.ndarray
    prior: np.ndarray


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter and a space if not."""
    if not _letters:
        _letters.append(np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """The lower-cased text's letters, with a gap for each other character, and gaps around."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.full(len(raw) + 2, 32, dtype=np.uint32)
    out[1:-1] = letter_table()[raw]
    return out


def pieces(points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a text, and how many n-grams of each length start in it; the n-grams of all parts are the text's."""
    for at in range(0, len(points), PIECE):
        yield points[at : at + PIECE + N - 1], min(PIECE, len(points) - at)


def grams(points: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Buckets (N, len(points)) of the 1-, 2- and 3-grams that start at each point; 1 << bits where none does.

    ``points`` holds parts one after the other, ``starts`` (parts, 3): where each begins, its end, and the end of its n-grams' starts.
    """
    n, none = len(points), 1 << bits
    out = np.full((N, n), none, dtype=np.int64)
    mixed = np.zeros(n, dtype=np.uint32)
    ok = np.zeros(n + 1, dtype=np.int8)
    np.add.at(ok, starts[:, 0], 1)
    np.add.at(ok, starts[:, 2], -1)
    ok = np.cumsum(ok[:n]).astype(bool)
    for k, m in enumerate(MULTIPLIERS):
        mixed = mixed[: n - k] * np.uint32(31) + (points[k:] + np.uint32(k)) * m
        out[k, : n - k] = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)
        inside = ok.copy()
        for back in range(1, k + 1):  # n-grams don't reach beyond their part
            inside[starts[:, 1] - back] = False
        out[k, ~inside] = none
    return out


def batches_of_parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points, starts and text numbers of parts, about ``PIECE`` letters at a time; texts without a letter have none."""
    held: list[np.ndarray] = []
    marks: list[tuple[int, int, int, int]] = []
    n = 0
    for i, text in enumerate(texts):
        points = code_points(text) if text else None
        if points is None or not (points != 32).any():
            continue
        for part, own in pieces(points):
            held.append(part)
            marks.append((n, n + len(part), n + own, i))
            n += len(part)
            if n >= PIECE:
                at = np.array(marks)
                yield np.concatenate(held), at[:, :3], at[:, 3]
                held, marks, n = [], [], 0
    if held:
        at = np.array(marks)
        yield np.concatenate(held), at[:, :3], at[:, 3]


def count_grams(bits: int):
    """A function of batches (lang, text) that gives a task's counts of n-grams, and of texts in the last bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                table = counts.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
                table[-1] += len(rows)
                for points, starts, _ in batches_of_parts(rows["text"].tolist()):
                    table[:-1] += np.bincount(grams(points, starts, bits).ravel(), minlength=(1 << bits) + 1)[:-1]
        for lang, table in counts.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": table[at]})
        release_memory()

    return count


def fit_languages(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """The model of rows with lang and text; all of them count."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    n_langs, bits = rows.select("lang").distinct().count(), BITS
    while bits > LEAST_BITS and n_langs << bits > ENTRIES:
        bits -= 1
    counts = rows.mapInPandas(count_grams(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def dense(one: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << bits) + 1, dtype=np.int64)
        table[one["bucket"]] = one["n"]
        return pd.DataFrame({"lang": one["lang"].iloc[:1], "counts": [table.tobytes()]})

    found = counts.groupBy("lang").applyInPandas(dense, "lang string, counts binary").collect()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return LanguageModel([], bits, np.zeros((0, (1 << bits) + 1)), np.zeros(0))
    by = {r["lang"]: np.frombuffer(r["counts"], dtype=np.int64) for r in found}
    out, texts = np.zeros((len(langs), (1 << bits) + 1), dtype=np.float32), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        held = by.pop(lang)
        smooth = held[:-1] + smoothing
        out[i, :-1], texts[i] = np.log(smooth / smooth.sum()), held[-1]
    return LanguageModel(langs, bits, out, np.log(texts / texts.sum()))


def predict(model: LanguageModel, texts: list[str | None]) -> pd.DataFrame:
    """lang_pred, score (the posterior probability) and fit: how much likelier, per n-gram, the text is than in equally likely n-grams."""
    n, k = len(texts), len(model.langs)
    total, count = np.zeros((n, k)), np.zeros(n, dtype=np.int64)
    if k:
        for points, starts, of in batches_of_parts(texts):
            buckets = grams(points, starts, model.bits)
            np.add.at(count, of, np.add.reduceat((buckets < 1 << model.bits).sum(axis=0), starts[:, 0]))
            for i in range(k):
                gathered = model.grams[i][buckets].sum(axis=0, dtype=np.float64)
                np.add.at(total[:, i], of, np.add.reduceat(gathered, starts[:, 0]))
    told = count > 0
    per_gram = np.divide(total.max(axis=1), count, out=np.zeros(n), where=told) if k else np.zeros(n)
    total = total + model.prior
    best = total.argmax(axis=1) if k else np.zeros(n, dtype=np.int64)
    top = total[np.arange(n), best][:, None] if k else np.zeros((n, 1))
    score = np.where(told, 1.0 / np.exp(total - top).sum(axis=1), 0.0) if k else np.zeros(n)
    langs = np.array([*model.langs, "und"], dtype=object)[np.where(told, best, k)]
    return pd.DataFrame({"lang_pred": langs, "score": score, "fit": np.where(told, per_gram + model.bits * np.log(2), 0.0)})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with __predicted: lang_pred, score and fit; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, fit double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield predict(shared.value, batch.tolist())
        release_memory()

    return docs.withColumn("__predicted", predicted("text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = fit_languages(docs.where(~held_out))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "__predicted.lang_pred", "__predicted.score")
