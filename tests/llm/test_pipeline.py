"""The stages of corpus_pipeline against brute force, and all of them in a row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gleanwork.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"xa": "ba be bi bo".split(), "xb": "ku ke ka zz".split(), "xc": "äö üm ñi é".split()}


def speak(lang, seed, n=30):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SOUNDS[lang], k=3)) for _ in range(n))


def frame(spark, rows):
    """rows: doc_id, text, lang, source."""
    return spark.createDataFrame([(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows], DOCS)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_language_stage(spark):
    good = [(i, speak(x, i), x, "s") for i, x in enumerate(list(SOUNDS) * 40)]
    bad = [(900, "12 %% 34", "xa", "s"), (901, None, "xa", "s"), (902, "", None, "s"), (903, speak("xb", 1), "xa", "s"), (904, "QXJ VWP HTG LRD FNY " * 9, None, "s"), (905, "Привет мир как дела", None, "s")]
    fine = [(906, speak("xc", 2), None, "s"), (None, speak("xa", 3), "xa", "s")]
    docs = frame(spark, good + bad + fine)
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns and ids(got) == sorted([r[0] for r in good + fine], key=str)
    some = corpus_pipeline.language_stage(spark, docs, "", languages=("xb", "xc"))
    assert ids(some) == sorted([i for i, _, x, _ in good if x != "xa"] + [906], key=str)
    assert corpus_pipeline.language_stage(spark, docs.limit(0), "").count() == 0


def test_quality_stage(spark, prose, folder):
    good = [(i, prose(i, 60) + ".", "l", "s") for i in range(250)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "l", "s") for i in range(250)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in [r[0] for r in good + bad] if i % 3], "doc_id long, quality int")
    docs = frame(spark, good + bad + [(None, prose(7, 60) + ".", "l", "s")])
    got = corpus_pipeline.quality_stage(spark, docs, folder(labels=labels))
    assert got.columns == docs.columns and ids(got) == sorted([r[0] for r in good] + [None], key=str)


def test_bands_meet_the_miss_rate():
    assert neardup.bands_for(80) == 49 and (1 - 0.8**7) ** 49 <= 1e-5 < (1 - 0.8**7) ** 48


def plain_set(text, words):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_neardup_stage(spark, prose, monkeypatch):
    used = []
    real = corpus_pipeline.near_duplicates
    monkeypatch.setattr(corpus_pipeline, "near_duplicates", lambda docs, how: used.append(how) or real(docs, how))
    r, rows = random.Random(3), [(i, prose(i, 120), "xx", "s") for i in range(20)]
    for i in range(20):
        words = rows[i][1].split()
        for _ in range(i % 5):
            words[r.randrange(120)] = f"odd{r.randrange(99)}"
        rows.append((100 + i, " ".join(words), "xx", "s"))
    rows += [(None, rows[0][1], "xx", "s"), (3, rows[3][1], "xx", "s"), (200, None, "xx", "s"), (201, "", "xx", "s")]
    sets = {i: plain_set(t, 5) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert ids(corpus_pipeline.neardup_stage(spark, frame(spark, rows), "")) == sorted([None, *(i for i in sets if find(i) == i)], key=str)
    assert (1 - (used[0].percent / 100) ** used[0].rows) ** used[0].bands <= 1e-5


def test_mixing_stage(spark, prose):
    rows = [(i, prose(i, 5 + i % 30), "xx", f"s{i % 3}" if i % 7 else None) for i in range(400)] + [(None, prose(9, 8), "xx", "s0"), (900, None, "xx", "s1")]
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        left, free = 1.5 * sum(size.values()) - sum(capped.values()), [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = {s: 2.0 * size[s] for s in free if weight[s] * level > 2.0 * size[s]}
        if not over:
            break
        capped.update(over)
    rate = {s: capped.get(s, weight[s] * level) / size[s] for s in order}
    docs = frame(spark, rows)
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    times = Counter(r["doc_id"] for r in got.collect())
    for i, _, _, s in rows:
        if i is not None:
            draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
            assert times[i] == math.floor(rate[s]) + (draw < rate[s] - math.floor(rate[s]))


def test_packing_stage_and_run(spark, prose, folder):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    told = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    told.encode_special_tokens = True
    encoded = lambda t: [*told.encode(t or "", add_special_tokens=False).ids, 0]
    rows = [(i, prose(i, 10 + i), "xx", "s") for i in range(60)] + [(5, prose(5, 15), "xx", "s"), (None, None, "xx", "s")]

    def check(got, texts, least):
        ends, words = {}, Counter()
        for r in got:
            part = np.frombuffer(r["ids"], "<u4").tolist()
            assert part in [encoded(t)[r["start"] : r["start"] + r["length"]] for t in texts[r["doc_id"]]] and r["ids_crc32"] == zlib.crc32(r["ids"])
            ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            words[r["doc_id"]] += r["length"]
        for spans in ends.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 1024
        assert set(words) >= least
        return words

    texts: dict = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    words = check(corpus_pipeline.packing_stage(spark, frame(spark, rows), "").collect(), texts, set(texts))
    assert words == {i: sum(len(encoded(t)) for t in ts) for i, ts in texts.items()}
    # all five in a row: misstated, bad and repeated documents go, the rest is packed
    good = [(i, speak(("xa", "xb", "xc")[i % 3], i, 80), ("xa", "xb", "xc")[i % 3], f"s{i % 2}") for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split()), x, "s0") for i, t, x, _ in good]
    copies = [(2000 + i, t, x, s) for i, t, x, s in good[:40]]
    wrong = [(3000, speak("xa", 999, 80), "xb", "s1"), (3001, "99", "xa", "s1")]
    every = [*good, *bad, *copies, *wrong]
    labels = spark.createDataFrame([(i, int(i < 1000 or i >= 2000)) for i, *_ in every[:340] if i % 4], "doc_id long, quality int")
    at = folder(documents=frame(spark, every), labels=labels)
    got = corpus_pipeline.run(spark, at).collect()
    words = check(got, {i: [t] for i, t, *_ in every}, set())
    assert set(words) <= {i for i, *_ in good} and len(words) >= 100
    assert all(n % len(encoded(good[i][1])) == 0 for i, n in words.items())
