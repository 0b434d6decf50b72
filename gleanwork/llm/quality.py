"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: characters (1- to 3-grams of the raw
text), words (1- and 2-grams) and the sequence of whether words repeat the one before
(1- and 2-grams). Class counts over *all* training rows are summed in Spark and give
each bucket its log-count ratio; indicators scaled by those ratios, at unit length, are
the inputs of a linear hinge-loss model fitted by dual coordinate descent on a bounded
sample: about ``max_rows`` different training rows, those of the smallest hashes, never
more than twice that nor more than ``max_features`` indicators together; a row that
repeats weighs as often as it occurs. Margins become scores by a logistic curve fitted on
a second, disjoint sample of a quarter of that size.

Nulls and edge cases: a null text counts as empty, and an empty text scores the
curve at the model's bias; labels other than 0 and 1, or null, teach nothing; a
document labelled repeatedly counts once per label row; with one class or no class
at all in the training rows every score is that class's share (0.5 if none); texts
of any length are read whole; only doc_id and text are read from documents, only
doc_id and the label from labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import crc_bucket, documents, materialize, release_memory

BITS = 17
BUCKETS = 1 << BITS
CHAR_BITS = 16
PIECE = 1 << 18
MEMO = 200_000
#: Labels up to which they are broadcast to the scan of the texts (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Different rows that the sample takes of a class, on average at least, if there are as many.
LEAST_OF_CLASS = 200


class _WordHashes(dict):
    """Hashes of words met before; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return h


class Indicators:
    """Distinct feature buckets of a text: characters in the lower half, words in the upper."""

    def __init__(self) -> None:
        self.hashes = _WordHashes()
        self.mark = np.zeros(BUCKETS, dtype=bool)

    def _set(self, mixed: np.ndarray, base: int) -> None:
        self.mark[base + ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CHAR_BITS))] = True

    def __call__(self, text: str | None) -> np.ndarray:
        mark, text = self.mark, text or ""
        mark[:] = False
        for at in range(0, len(text), PIECE):
            raw = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "replace"), dtype=np.uint32)
            one = raw * np.uint32(0x9E3779B1)
            two = one[:-1] * np.uint32(31) + raw[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(31) + raw[2:] * np.uint32(0xC2B2AE3D)
            for mixed in (one, two, three):
                self._set(mixed, 0)
        h = np.fromiter(map(self.hashes.__getitem__, text.split()), dtype=np.uint32)
        if len(h):
            self._set(h * np.uint32(0x9E3779B1) + np.uint32(1), 1 << CHAR_BITS)
            self._set(h[:-1] * np.uint32(0x85EBCA77) + h[1:], 1 << CHAR_BITS)
            same = (h[1:] == h[:-1]).astype(np.uint32)
            self._set(same * np.uint32(0xC2B2AE3D) + np.uint32(2), 1 << CHAR_BITS)
            self._set((same[:-1] * np.uint32(2) + same[1:]) * np.uint32(0xC2B2AE3D) + np.uint32(3), 1 << CHAR_BITS)
        return np.flatnonzero(mark)


def class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found, counts = Indicators(), np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        for label, text in zip(batch["label"], batch["text"], strict=True):
            counts[int(label), found(text)] += 1
            counts[int(label), BUCKETS] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": at.astype(np.int32), "n0": counts[0, at], "n1": counts[1, at]})
    release_memory()


def log_count_ratios(train: DataFrame, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's log-count ratio of label 1 against label 0 over all rows, and the rows of each label."""
    counts = train.mapInPandas(class_counts, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = counts.toPandas()  # at most BUCKETS + 1 rows
    n = np.zeros((2, BUCKETS + 1))
    n[0, table["bucket"]], n[1, table["bucket"]] = table["n0"], table["n1"]
    share = [(n[c, :BUCKETS] + smoothing) / (n[c, BUCKETS] + 2 * smoothing) for c in (0, 1)]
    return np.log(share[1] / share[0]).astype(np.float32), n[:, BUCKETS]


def unit_scale(ratios: np.ndarray, at: np.ndarray) -> float:
    """What brings the indicators at these buckets, times their ratios, to unit length."""
    r = ratios[at].astype(np.float64)
    return 1.0 / max(float(np.sqrt(r @ r)), 1e-9)


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2/2 + sum cost_i * hinge(y_i, w x_i), by one dual variable at a time.

    x_i is 1 for the bias, and the ratios at the buckets rows[i], at unit length.
    """
    w, alpha, draw = np.zeros(BUCKETS + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    scale = [unit_scale(ratios, at) for at in rows]
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            at = rows[i]
            v = ratios[at] * scale[i]
            slope = y[i] * (w[at] @ v + w[BUCKETS]) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[at] += step * v
                w[BUCKETS] += step
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """slope, shift of P(label 1) = 1 / (1 + exp(-(slope * margin + shift))), by damped Newton steps on smoothed targets; a row counts ``times`` times."""
    up, down = times[y == 1].sum(), times[y == 0].sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    b = np.array([1.0, 0.0])
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (times * (t - p)))
        b = b + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


class QualityModel:
    """Indicator weights, with the ratios folded in, the bias and the logistic curve."""

    def __init__(self, ratios: np.ndarray, w: np.ndarray, slope: float, shift: float) -> None:
        self.ratios, self.w, self.bias, self.slope, self.shift = ratios, w[:BUCKETS].astype(np.float32), float(w[BUCKETS]), slope, shift

    def margin(self, at: np.ndarray) -> float:
        return float(self.w[at] @ self.ratios[at]) * unit_scale(self.ratios, at) + self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.shift, -500, 500))))


def fit_quality(train: DataFrame, max_rows: int = 8000, cost: float = 4.0, max_features: int = 1 << 24) -> QualityModel:
    """``train``: doc_id, text, label (0 or 1). The ratios read every row; the two fits read the bounded samples."""
    train = train.where(F.col("label").isin(0, 1)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    ratios, rows = log_count_ratios(train)
    if not rows.all():
        share = 0.5 if not rows.any() else float(rows[1] > 0)
        return QualityModel(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS + 1), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    @F.pandas_udf("array<int>")
    def indicators(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Indicators()
        for batch in texts:
            yield pd.Series([found(t).astype(np.int32) for t in batch])
        release_memory()

    wanted = max_rows + max_rows // 4
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    # shares are of different rows, so repeats don't thin them out; a rare class keeps enough to learn from
    each = {r["label"]: r["n"] for r in train.select(spread.alias("h"), "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = {label: max(wanted / sum(each.values()), LEAST_OF_CLASS / n) for label, n in each.items()}
    picked = train.withColumn("h", spread).where(share < F.when(F.col("label") == 1, part[1]).otherwise(part[0]))
    different = picked.groupBy("h", "label").agg(F.first("text").alias("text"), F.count("*").alias("n"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, labels, times, held = [], [], [], 0
        for batch in batches:
            for one, label, n in zip(batch["at"], batch["label"], batch["n"], strict=True):
                held += len(one)
                if held <= max_features and len(at) < 2 * wanted:
                    at.append(np.array(one, dtype=np.int32))
                    labels.append(label)
                    times.append(n)
        if at:
            w, slope, shift = fit_sample(at, np.array(labels), np.array(times, dtype=np.float64), ratios, cost)
            yield pd.DataFrame({"w": [w], "slope": slope, "shift": shift})
        at.clear()
        release_memory()

    sample = different.select("h", "label", "n", indicators("text").alias("at")).repartition(1).sortWithinPartitions("h", "label")
    got = sample.mapInPandas(fit, "w array<double>, slope double, shift double").first()
    if got is None:  # so few different rows that none was chosen
        return QualityModel(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS + 1), 0.0, float(np.log((rows[1] + 1e-6) / (rows[0] + 1e-6))))
    return QualityModel(ratios, np.array(got["w"]), got["slope"], got["shift"])


def fit_sample(at: list[np.ndarray], labels: np.ndarray, times: np.ndarray, ratios: np.ndarray, cost: float) -> tuple[np.ndarray, float, float]:
    """Weights, slope and shift from the sample's buckets, labels and repeats, of which a fifth is for the curve."""
    fit_on = np.arange(len(at)) % 5 != 4
    y = np.where(labels == 1, 1.0, -1.0)
    balance = times.sum() / np.maximum(1, 2 * np.where(labels == 1, times[labels == 1].sum(), times[labels == 0].sum()))
    w = dual_coordinate_descent([at[i] for i in np.flatnonzero(fit_on)], ratios, y[fit_on], (cost * balance * times)[fit_on])
    model = QualityModel(ratios, w, 1.0, 0.0)
    rest = np.flatnonzero(~fit_on) if (~fit_on).sum() >= 20 else np.arange(len(at))
    return w, *logistic_fit(np.array([model.margin(at[i]) for i in rest]), labels[rest], times[rest])


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with __score, 0 to 1; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found, m = Indicators(), shared.value
        for batch in texts:
            yield pd.Series([m.score(found(t)) for t in batch], dtype="float64")
        release_memory()

    return docs.withColumn("__score", scored("text"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their quality label: few labels are broadcast to the texts; beyond ``BROADCAST_ROWS`` both are shuffled by id."""
    marks = materialize(labels.select(F.col("doc_id").alias("__marked"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1)))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("__marked")).select("doc_id", "text", "label")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = fit_quality(labelled(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))
