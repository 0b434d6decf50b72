"""Mixing, sharding and license scans against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import licenses, mixing, sharding

DOCS = "doc_id long, text string, source string"


def test_rates_by_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, None: 50}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r for r in mixing.source_rates(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:  # share again by weight until none is above its cap
        left, free = total - sum(capped.values()), [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = {s: 2.0 * sizes[s] for s in free if weight[s] * level > 2.0 * sizes[s]}
        if not over:
            break
        capped.update(over)
    want = {s: capped.get(s, weight[s] * level) for s in order}
    for s in order:
        assert got[s]["target"] == pytest.approx(want[s]) and got[s]["rate"] <= 2.0


def test_mix_edges(spark, prose, folder):
    rows = [(i, prose(i, 20), "s1" if i % 3 else "s2") for i in range(300)] + [(900, None, "s1"), (901, "", None), (902, "x", None), (902, "x", None), (None, "y z", "s2")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("rate", F.lit(1))
    got = mixing.op5_mixing(spark, folder(documents=docs)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["target"]][0] += r["taken"]
    for target, (taken, _) in by.items():
        assert abs(taken - target) <= max(0.25 * target, 4)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(times[r["doc_id"]] == r["copies"] * (2 if r["doc_id"] == 902 else 1) for r in got)
    nameless = spark.createDataFrame([(None, prose(i, 10), "s" if i % 2 else "t") for i in range(400)], DOCS)
    drawn = [r["copies"] for r in mixing.mix_plan(nameless).collect()]
    assert len(set(drawn)) > 1 and sum(drawn) == pytest.approx(600, rel=0.1)
    assert mixing.op5_mixing(spark, folder(**{"empty/documents": docs.limit(0)}) + "/empty").count() == 0


def check_shards(got, rows, shards=40):
    """Bytes per shard; every row once, slots gapless, and equal texts together unless they are more than a shard's share."""
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in rows)
    size, slots, where, group = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
        group[r["text_crc32"], r["size"]] += r["size"]
    assert sorted(size) == list(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / shards
    assert all(len(s) == 1 or group[t] > share for t, s in where.items())
    return size, share


def test_shards_by_bytes(spark, prose, folder):
    rows = [(i, prose(i, 5 + i % 40), "s") for i in range(6000)] + [(7000 + i, "the same text again", "s") for i in range(1500)] + [(9000, None, None), (9001, "", None), (None, "no id", "s"), (1, prose(1, 6), "s")]
    rows += [(10_000 + i, "a larger text " * 80, "s") for i in range(60)] + [(11_000 + i, f"copies {i % 40} " * 30, "s") for i in range(400)] + [(5, prose(5, 10), "s")] * 300
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash"))
    size, share = check_shards(sharding.op8_sharding(spark, folder(documents=docs)).collect(), [t for _, t, _ in rows])
    assert all(abs(n - share) < 0.05 * share for n in size.values())
    huge = spark.createDataFrame([(i, "x" * 100, "s") for i in range(50)] + [(99, "y" * 5000, "s")], DOCS)
    got = sharding.shard_by_bytes(huge, shards=4).collect()
    assert sorted(Counter(r["shard"] for r in got).values())[0] == 1 and len(got) == 51
    assert sharding.op8_sharding(spark, folder(**{"empty/documents": docs.limit(0)}) + "/empty").count() == 0


def base_places(text):
    words = re.findall(licenses.WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for label, exact, phrase in licenses.TEMPLATES if exact for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_places(spark, prose, folder):
    long_mit = next(w for label, _, w in licenses.TEMPLATES if label == "mit" and w.startswith("permission") and len(w.split()) < 30)
    texts = [
        "Released under the MIT License.", "under the mit", "x Under-the MIT license under the mit license", None, "", "cc by-nc 4.0 / CC BY NC", "Apache License, Version 2.0 and ccé by nc",
        prose(1, 300) + " cc by nc " + prose(2, 300), long_mit.replace("charge", "any charge") + " the end", "permission is hereby granted", "by nc cc by", "a b",
        "\u212a\u0130 CC\u00a0BY NC cc by nc", "cc by nc " * 3000,
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (0, "cc by nc", "s"), (None, texts[5], "s")]
    got = licenses.op9_licenses(spark, folder(documents=spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit(1)))).collect()
    mine = sorted(([str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] for r in got), key=repr)
    assert mine == sorted(([str(i), *base_places(t)] for i, t, _ in rows), key=repr)
    told = {r["doc_id"]: r for r in got}
    assert told[8]["labels"] == "mit" and told[8]["base_labels"] == "" and 0.6 <= told[8]["score"] < 1 and told[9]["labels"] == ""
    assert licenses.op9_licenses(spark, folder(**{"empty/documents": spark.createDataFrame([], DOCS)}) + "/empty").count() == 0


def brute_spans(text, templates, min_share=0.6, min_dense=0.5, gap=2):
    """Labels of the spans that hold enough distinct grams of a template."""
    words, labels = re.findall(licenses.WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text)), set()
    for label, exact, phrase in templates:
        t = phrase.split()
        n = len(t) - 2
        hits = sorted((d - p, p) for p in range(n) for d in range(len(words) - 2) if words[d : d + 3] == t[p : p + 3])
        runs = []
        for diagonal, p in hits:
            if not runs or diagonal - runs[-1][-1][0] > (0 if exact else gap):
                runs.append([])
            runs[-1].append((diagonal, p))
        for run in runs:
            held, at = len({p for _, p in run}), [d + p for d, p in run]
            if held == n if exact else held >= min_share * n and held >= min_dense * (max(at) - min(at) + 1):
                labels.add(label)
    return labels


def test_a_position_votes_once(spark):
    template = [("t", False, "x y x y p q r s t u")]
    docs = spark.createDataFrame([(1, "x y x y x y x y"), (2, "x y x y p q r s t u"), (3, "x y x y p q r z s t u")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_spans(docs, templates=template).collect()}
    assert set(got) == {2, 3} and got[2]["share"] == 1.0 and got[3]["share"] == 0.75


def test_license_labels_against_brute_force(spark, prose):
    import random

    draw, texts = random.Random(8), []
    for label, notice in licenses.NOTICES:
        words = notice.split()
        for edits in (0, 3, len(words)):
            w = list(words)
            for _ in range(edits):
                w[draw.randrange(len(w))] = draw.choice(["odd", "", "of the", "software"])
            texts.append(f"{prose(len(texts), 40)} {' '.join(w)} {prose(len(texts) + 1, 40)}")
        texts.append(" ".join(words[: len(words) // 2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: ",".join(sorted(brute_spans(t, licenses.TEMPLATES))) for i, t in enumerate(texts)}
    assert all(label in got[4 * i].split(",") for i, (label, _) in enumerate(licenses.NOTICES))


def test_mixing_equals_its_sql(spark, prose, folder):
    import duckdb

    from gleanwork.llm.queries import SQL

    rows = [(i, prose(i, 3 + i % 50), f"s{i % 5}" if i % 11 else None) for i in range(500)] + [(None, "a b", "s1"), (901, None, "s2")]
    at = folder(documents=spark.createDataFrame(rows, DOCS))
    got = mixing.op5_mixing(spark, at)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at.removeprefix('file://')}/documents.parquet/*.parquet'")
    told = con.sql(SQL["op5_mixing"])
    assert sorted(map(tuple, got.select(*told.columns).collect()), key=repr) == sorted(told.fetchall(), key=repr)
