"""Importance resampling against plain loops over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanwork.llm import resampling
from gleanwork.operators import joins

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, buckets=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, share=(5, 100), least=20):
    corpus, wanted = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    whole, other = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (whole + 10000) / ((corpus[b] + 1.0) * (other + 10000))))
    rows = []
    for i, t in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in features(t))
        rows.append((i, len(features(t)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= least))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(enough[: share[0] * len(enough) // share[1]])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_hash_of_joined_words():
    draw = random.Random(5)
    for length in (0, 1, 2, 3, 31, 64, 1000, 70_001):
        a, b = draw.randbytes(40), draw.randbytes(length)
        moved = resampling.transformed(resampling.zeros(length)[None], np.zeros(1, dtype=np.int64), np.array([zlib.crc32(a)], dtype=np.uint32))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("size", [1, 17, 64, 1 << 22])
def test_slices_give_the_same_features(size):
    draw = random.Random(size)
    texts = ["", "a", "a b", "A-B_c  d", "é" * 40 + " x " + "z" * 90, "\x00\x7f", "one two three four", "中文字 " * 30, "tail " + "w" * 25, " lead and trail ", "...", "x" * 200]
    texts += [" ".join(draw.choices(["ab", "Cd", "e,f", "ghi12", "日本", "-"], k=draw.randrange(60))) for _ in range(40)]
    told, number = Counter(), Counter()
    for keys, parts, skip in resampling.sliced((((i,), t.encode()) for i, t in enumerate(texts)), size):
        bucket, owner, count = resampling.hashed_features(parts, skip)
        told.update((keys[o][0], b) for o, b in zip(owner.tolist(), bucket.tolist(), strict=True))
        for key, n in zip(keys, count.tolist(), strict=True):
            number[key[0]] += n
    assert told == Counter((i, b) for i, t in enumerate(texts) for b in features(t))
    assert all(number[i] == len(words(t)) for i, t in enumerate(texts))


@pytest.mark.parametrize("slice_bytes", [60, 1 << 22])
def test_against_plain_loops(spark, prose, slice_bytes):
    docs = [(i, prose(i, 5 + i % 60)) for i in range(150)]
    docs += [(1000 + i, prose("hot", 30)) for i in range(100)]  # a third of all rows
    docs += [(2000, None), (2001, ""), (2002, "..."), (2003, "word " * 5000), (2003, "word " * 5000), (2004, "Ärger über Öl " * 8), (None, prose(1, 30)), (None, prose("hot", 30)), (3, prose(4, 40))]
    target = [prose(i, 40) for i in range(3)] + [None, ""]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS digest", "1 AS n", "2 AS weight", "3 AS rank").repartition(5)
    told = resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), slice_bytes=slice_bytes)
    assert got(told) == plain(docs, target)


def test_frequent_and_rare_texts_are_joined(spark, monkeypatch):
    docs = [(i, f"text {i % 40} " * 12) for i in range(400)] + [(900 + i, "the same " * 15) for i in range(200)]
    monkeypatch.setattr(joins, "FREQUENT", 10)  # only the last text is broadcast
    assert got(resampling.resampled(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("text 3 the",)], "text string"))) == plain(docs, ["text 3 the"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.resampled(none, target).count() == 0
    docs = [(i, "some words here " * 9) for i in range(30)]
    assert got(resampling.resampled(spark.createDataFrame(docs, DOCS), target.limit(0))) == plain(docs, [])
