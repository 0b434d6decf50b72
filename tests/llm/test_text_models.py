"""Language, quality, HTML, near-duplicates and packing: brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import html_text, language, neardup, packing, quality, tokenize

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string"
SOUNDS = {"xa": "ba be bi bo".split(), "xb": "ku ke ka zz".split(), "xc": "äö üm ñi é".split()}


def speak(lang, seed, n=30):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SOUNDS[lang], k=3)) for _ in range(n))


def test_language_held_out(spark, folder):
    rows = [(i, speak(lang, i), lang, "s") for i, lang in enumerate(list(SOUNDS) * 60)]
    odd = [(1000, None, "xa", "s"), (1001, "", None, "s"), (1002, "12 %% 34", "xa", "s"), (1003, speak("xb", 1, 90_000), None, None), (None, speak("xc", 5), "xc", "s"), (5, rows[5][1], "xc", "s")]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("clash"))
    got = language.op7_language_id(spark, folder(documents=docs)).collect()
    assert len(got) == len(rows) + len(odd)
    told = {r["doc_id"]: r for r in got}
    assert all(told[i]["lang_pred"] == lang for i, _, lang, _ in rows) and told[1003]["lang_pred"] == "xb"
    assert [told[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and told[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    empty = folder(**{"empty/documents": docs.limit(0)}) + "/empty"
    assert language.op7_language_id(spark, empty).count() == 0
    blank = folder(**{"blank/documents": docs.withColumn("lang", F.lit(None).cast("string"))}) + "/blank"
    assert {r["lang_pred"] for r in language.op7_language_id(spark, blank).collect()} == {"und"}


def plain_grams(text, bits=language.BITS):
    """Buckets of the text's n-grams, one by one."""
    points, out = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32], Counter()
    for i in range(len(points)):
        h = 0
        for k, m in enumerate(language.MULTIPLIERS.tolist()):
            if i + k < len(points):
                h = (h * 31 + (points[i + k] + k) * m) % 2**32
                out[((h * 0x27D4EB2F) % 2**32) >> (32 - bits)] += 1
    return out


def test_scores_are_those_of_naive_bayes(spark, prose, monkeypatch):
    rows = [(lang, speak(lang, i, 1 + 7 * i)) for i in range(12) for lang in SOUNDS] + [("xa", "Ab"), ("xb", ""), ("xb", None), (None, "abc")]
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    counts, texts = {x: Counter() for x in SOUNDS}, Counter()
    for lang, text in rows:
        if lang and text is not None:
            texts[lang] += 1
            counts[lang] += plain_grams(text) if text else Counter()
    asked = [t for _, t in rows] + ["a", "ku zz äö", "12", "ba" * 5000]
    for piece in (1 << 16, 50):
        monkeypatch.setattr(language, "PIECE", piece)
        got = language.predict(model, asked)
        for text, lang, score in zip(asked, got["lang_pred"], got["score"], strict=True):
            if not text or not any(c.isalpha() for c in text):
                assert (lang, score) == ("und", 0.0)
                continue
            logs = {x: np.log(texts[x] / sum(texts.values())) for x in SOUNDS}
            for x in SOUNDS:
                whole = sum(c for c in counts[x].values()) + 0.5 * (1 << language.BITS)
                logs[x] += sum(n * np.log((counts[x][b] + 0.5) / whole) for b, n in plain_grams(text).items())
            best = max(sorted(logs), key=logs.get)
            assert lang == best and score == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_language_ties_and_many_languages(spark, monkeypatch):
    same = spark.createDataFrame([("xb", "ba be"), ("xa", "ba be")], "lang string, text string")
    assert language.predict(language.fit_languages(same), ["ba"])["lang_pred"].tolist() == ["xa"]
    monkeypatch.setattr(language, "ENTRIES", 1 << 12)
    rows = [(f"l{i:02}", f"{chr(97 + i)}{chr(98 + i)} " * 9) for i in range(20)]
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert model.bits == 7 and language.predict(model, [t for _, t in rows])["lang_pred"].tolist() == [x for x, _ in rows]


def test_quality_held_out(spark, prose, folder):
    good = [(i, prose(i, 60) + ".", "l", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()), "l", "s") for i in range(300)]
    odd = [(5000, None, None, None), (5001, "", None, None), (None, "x y", "l", "s"), (0, good[0][1], "l", "s")]
    docs = spark.createDataFrame(good + bad + odd, DOCS).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in [r[0] for r in good + bad]] + [(5001, None), (77, 5), (None, 1), (1, 1)], "doc_id long, quality int")
    at = folder(documents=docs, labels=labels)
    got = quality.op2_quality(spark, at).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert len(held) > 80 and np.mean([(r["doc_id"] < 1000) == bool(r["predicted"]) for r in held]) > 0.97
    none = folder(**{"none/documents": docs, "none/labels": labels.limit(0)}) + "/none"
    assert {r["score"] for r in quality.op2_quality(spark, none).collect()} == {0.5}
    empty = folder(**{"empty/documents": docs.limit(0), "empty/labels": labels}) + "/empty"
    assert quality.op2_quality(spark, empty).count() == 0


def plain_indicators(text):
    """Buckets of the text's characters and words, one n-gram at a time."""
    def at(h, base):
        return base + (((h * 0x27D4EB2F) % 2**32) >> (32 - quality.CHAR_BITS))

    c, w, out = [ord(x) for x in text], [zlib.crc32(x.encode()) for x in text.split()], set()
    for i in range(len(c)):
        one = c[i] * 0x9E3779B1
        out.add(at(one, 0))
        if i + 1 < len(c):
            out.add(at(one * 31 + c[i + 1] * 0x85EBCA77, 0))
        if i + 2 < len(c):
            out.add(at((one * 31 + c[i + 1] * 0x85EBCA77) * 31 + c[i + 2] * 0xC2B2AE3D, 0))
    half = 1 << quality.CHAR_BITS
    for i in range(len(w)):
        out.add(at(w[i] * 0x9E3779B1 + 1, half))
        if i + 1 < len(w):
            out.add(at(w[i] * 0x85EBCA77 + w[i + 1], half))
            out.add(at((w[i] == w[i + 1]) * 0xC2B2AE3D + 2, half))
        if i + 2 < len(w):
            out.add(at((2 * (w[i] == w[i + 1]) + (w[i + 1] == w[i + 2])) * 0xC2B2AE3D + 3, half))
    return sorted(out)


def test_indicators_and_ratios(spark, monkeypatch):
    texts = ["", "a", "ab cd ab cd", "é 日本 x\ty  z", "the the the the", "word " * 40]
    found = quality.Indicators()
    for piece in (1 << 18, 7):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert [found(t).tolist() for t in texts] == [plain_indicators(t) for t in texts]
    rows = [(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)]
    ratios, n = quality.log_count_ratios(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    counts = np.zeros((2, quality.BUCKETS))
    for _, t, label in rows:
        counts[label, plain_indicators(t)] += 1
    want = np.log(((counts[1] + 1) / (n[1] + 2)) / ((counts[0] + 1) / (n[0] + 2)))
    assert n.tolist() == [4, 2] and np.allclose(ratios, want, atol=1e-5)


def test_dual_coordinate_descent_finds_the_least_loss():
    draw = np.random.default_rng(3)
    rows = [np.sort(draw.choice(60, 12, replace=False)) for _ in range(80)]
    ratios = draw.normal(size=quality.BUCKETS).astype(np.float32)
    y = np.where(draw.random(80) < 0.5, 1.0, -1.0)
    cost = draw.uniform(0.5, 3, 80)
    x = np.zeros((80, 61))
    for i, at in enumerate(rows):
        x[i, at] = ratios[at] * quality.unit_scale(ratios, at)
        x[i, 60] = 1.0
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.dual_coordinate_descent(rows, ratios, y, cost, epochs=3000)
    w = np.append(w[:60], w[-1])
    best = loss(w)
    step, v = 0.5, np.zeros(61)
    for t in range(20_000):  # plain subgradient steps come no lower
        g = v - (x * (cost * y * (y * (x @ v) < 1))[:, None]).sum(axis=0)
        v = v - step / (1 + t) * g
    assert best <= loss(v) * 1.001 and all(best <= loss(w + draw.normal(size=61) * s) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_a_repeated_row_does_not_fill_the_sample(spark, prose):
    rows = [(1, "bad bad!! row", 0)] * 400 + [(10 + i, prose(i, 20), 1) for i in range(60)] + [(100 + i, prose(i, 20).upper(), 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    one, two = (quality.fit_quality(frame.repartition(k), max_rows=160) for k in (3, 5))
    assert np.array_equal(one.w, two.w) and (one.slope, one.shift) == (two.slope, two.shift)
    found = quality.Indicators()
    assert one.score(found(prose(500, 20))) > one.score(found(prose(500, 20).upper()))


PAGE = """<html><head><title>t</title><script>var a="<p>";</script></head><body><nav><a href=/>Home page</a></nav><div class="cookie-notice"><p>We and our partners use what is on your device and it is good.</p></div>
<article><h1>A &amp; B</h1><p>The first of the paragraphs is here, and it has<br>two lines of   words that are in the article.</p><p>Short.</p></article>
<div id="comments"><p>I think that this is the best of all the articles that you have written so far.</p></div><footer>&copy; all</footer></body></html>"""


def test_html_blocks(spark, folder):
    assert html_text.main_text(PAGE) == "A & B\n\nThe first of the paragraphs is here, and it has two lines of words that are in the article.\n\nShort."
    prose = "<p>" + "the cat and the dog of the house are in the garden now " * 6 + "</p>"
    plain = "<div class=menu><a href=x>One</a></div><h2>Head</h2>" + prose + "<p>Ok.</p>" + prose + "<form><p>name</p></form>"
    got = html_text.main_text(plain).split("\n\n")
    assert got[0] == "Head" and got[2] == "Ok." and len(got) == 4
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (3, None, ""), (None, "u", "<p>x"), (5, "u", "<" * 1000), (6, "u", "<article><p>" + "a" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.op4_html_text(spark, folder(pages=pages)).collect()
    assert len(out) == 7 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.op4_html_text(spark, folder(**{"empty/pages": pages.limit(0)}) + "/empty").count() == 0


def plain_set(text, words):
    """The contract's shingle set in plain strings."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words, percent):
    sets = [(i, plain_set(t, words)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_near_duplicates(spark, prose, folder):
    r = random.Random(5)

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice("new odd rare".split()) + str(r.randrange(99))
        return " ".join(w)

    rows = [(i, prose(i, 80)) for i in range(40)]
    base = prose("hot", 150)
    rows += [(100 + i, base) for i in range(60)] + [(200 + i, edited(base, r.randrange(1, 9))) for i in range(120)] + [(400 + i, edited(rows[i][1], 2)) for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, base), (7, base), (906, "É x y z"), (907, "é x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = neardup.op10_neardup(spark, folder(documents=docs)).collect()
    want = brute_components(rows, 3, 85)
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(plain_set(t, 3))) for i, t in rows)
    for row in got:
        if row["doc_id"] is not None:
            assert row["component_id"] == want[row["doc_id"]] and row["kept"] == (row["doc_id"] == row["component_id"])
    told = {row["doc_id"]: row["n_shingles"] for row in got}
    assert told[901] == told[902] == told[900] == 0 and told[903] == told[905] == 1 and want[903] == want[904] == 903 and want[907] == 907
    assert neardup.op10_neardup(spark, folder(**{"empty/documents": docs.limit(0)}) + "/empty").count() == 0


def test_large_families_and_buckets_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    base, draw = prose("grid", 120), random.Random(2)
    rows = [(i, base + f" tail{i} end{i}") for i in range(90)]
    # a chain whose ends are far apart, and documents that share half their words only
    words = prose("chain", 200).split()
    for i in range(60):
        words[draw.randrange(200)] = f"step{i}"
        words[draw.randrange(200)] = f"more{i}"
        rows.append((1000 + i, " ".join(words)))
    half = prose("half", 70)
    rows += [(2000 + i, f"{half} {prose(f'own{i}', 70)}") for i in range(120)] + [(3000 + i, f"{half} {prose(f'own{i}', 70)} x") for i in range(0, 120, 9)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Settings(words=3, percent=85)).collect()
    want = brute_components(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sum(v == 0 for v in want.values()) == 90 and len({v for k, v in want.items() if k >= 2000}) == 120


def test_sketches_estimate():
    how = neardup.Settings(words=3, percent=85)
    s, draw = neardup.Shingler(how), np.random.default_rng(1)
    worst = 0
    for _ in range(200):
        a = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = np.concatenate([a[:368], draw.integers(0, 1 << 63, 32, dtype=np.uint64)])  # similarity 0.852
        x, y = (s.sketch(s.min_hashes(np.unique(v))) for v in (a, b))
        worst = max(worst, int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
    assert worst <= how.sketch_limit()


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a b", "a\n\nb", "a \n b", "x  y", "it's don't 12 a1b2 ...", "\n", "a\n\n\nb", "é ü b", "a\tb", "foo<|endoftext|> bar", "tail \n", "a. B, (c) [d]\n- e: f", "x\n\n", "x\n\n y", "a_, b", "a!! b!!. c", "1.5, 2,3 4.", "a b  c", "日本 語, x。y"]


def test_encoder_is_exact(prose, monkeypatch):
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(TOKENIZER)
    told.encode_special_tokens = True
    encode, draw = tokenize.encoder(TOKENIZER), random.Random(4)
    letters = [*"aZ é\n\t 1.,'!s<|>“ß日本\u3000\xa0\r", "'ll", "  ", "\n\n", "\x85", "🙂", "endoftext"]
    texts = ODD + [prose(i, 200) for i in range(20)] + ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(3000)]
    texts += [f"a{chr(c)} {chr(c)}1\n{chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000] + ["a" * 50_000, " " * 50_000 + "x", "!?" * 20_000]
    want = [told.encode(x, add_special_tokens=False).ids for x in texts]
    assert tokenize.byte_level_ranks(TOKENIZER) is not None
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts] == want
    monkeypatch.setattr(tokenize, "SLICE", 50)
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts] == want
    monkeypatch.setattr(tokenize, "byte_level_ranks", lambda path: None)
    encode = tokenize.encoder(TOKENIZER)
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts[:500]] == want[:500]


def check_packing(got, ids, size=1024):
    """Every id lies in one piece, pieces lie gapless in their sequences; the number of sequences."""
    parts, spans = {}, {}
    for r in got:
        spans.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert "ids" not in r or r["ids"] == part
    for p in parts.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end and length > 0
            end += length
        assert end <= size
    for (_, n), found in spans.items():
        starts = sorted(found)
        times = sum(s == 0 for s, _ in starts)
        assert sum(k for _, k in starts) == times * n
        cover = np.zeros(n, int)
        for s, k in starts:
            cover[s : s + k] += 1
        assert (cover == times).all()
    return len(parts)


def encoded(rows):
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(TOKENIZER)
    told.encode_special_tokens = True
    return {i: [*told.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_packing_round_trip(spark, prose, folder):
    rows = [(i, prose(i, 1 + (i * 37) % 900)) for i in range(200)] + [(900, None), (901, ""), (902, "x"), (902, "x"), (None, "no id"), (903, prose(3, 9000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    at, ids = folder(documents=docs), encoded(rows)
    got = [r.asDict() for r in packing.pack(docs, TOKENIZER).collect()]
    n = check_packing(got, ids)
    total = sum(len(ids[i]) for i, _ in rows)
    assert sum(r["length"] for r in got) == total and total / (1024 * n) > 0.95
    digest = [r.asDict() for r in packing.op1_packing(spark, at).collect()]
    assert check_packing(digest, ids) == n and len(digest) == len(got)
    assert packing.op1_packing(spark, folder(**{"empty/documents": docs.limit(0)}) + "/empty").count() == 0


@pytest.mark.parametrize(("low", "high"), [(520, 680), (700, 700), (9, 9), (65, 70), (3, 1020)])
def test_padding_is_little_whatever_the_lengths(low, high):
    draw, counts, tokens = random.Random(6), {}, 0
    for _ in range(4000):
        n = draw.randint(low, high)
        kind = n if n <= packing.BUNDLED else min(1024, -(-n // packing.GRAIN) * packing.GRAIN)
        tokens += n if kind < 1024 else 0
        if kind < 1024:
            counts.setdefault(kind, np.zeros(packing.BUCKETS, dtype=np.int64))[draw.randrange(packing.BUCKETS)] += 1
    runs, after = packing.choose_cuts(counts, 1024)
    assert sum(k * n for k, n in after.items()) == sum(k * int(n.sum()) for k, n in counts.items())
    assert all(0 <= lo < hi <= packing.BUCKETS and 0 < first < kind for kind, found in runs.items() for lo, hi, first in found)
    items, of_kind = packing.items_of(after)
    assert {k: sum(hi - lo for lo, hi, *_ in found) for k, found in of_kind.items()} == after
    classes, n = packing._present(items)
    plan = packing.round_patterns(classes, n, *packing.solve_patterns(classes, n, 128)[:2], 128)
    assert tokens / 1024 / sum(times for _, times in plan) >= 0.97


def test_cut_pieces_come_back_whole(spark, prose, folder):
    rows = [(i, prose(i, 330 + i % 40)) for i in range(300)]
    ids = encoded(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.asDict() for r in packing.pack(docs, TOKENIZER).collect()]
    n = check_packing(got, ids)
    assert len(got) > len(rows) + sum(len(v) // 1024 for v in ids.values())
    assert sum(len(v) for v in ids.values()) / (1024 * n) > 0.96


def test_patterns_meet_every_count():
    lengths, counts = np.array([5, 9, 13, 40, 64, 90]), np.array([7, 11, 3, 20, 5, 9])
    plan = packing.round_patterns(lengths, counts, *packing.solve_patterns(lengths, counts.astype(float), 128)[:2], 128)
    used = {int(n): 0 for n in lengths}
    for pattern, times in plan:
        assert sum(n * c for n, c in pattern.items()) <= 128
        for n, c in pattern.items():
            used[n] += c * times
    assert used == dict(zip(lengths.tolist(), counts.tolist()))


@pytest.mark.parametrize("own_ids", [False, True])
def test_quality_of_repeated_rows(spark, own_ids):
    good, bad = "the cat and the dog of the house are in the garden now", "zx qq vv buy now buy now click click"
    odd = F.col("id") % 2 == 0
    rows = spark.range(80_000).select((F.col("id") if own_ids else F.lit(0)).cast("long").alias("doc_id"), F.when(odd, good).otherwise(bad).alias("text"), odd.cast("int").alias("label"))
    told = quality.score_quality(spark.createDataFrame([(good,), (bad,)], "text string"), quality.fit_quality(rows)).collect()
    score = {r["text"]: r["__score"] for r in told}
    assert score[good] > 0.9 and score[bad] < 0.1


def test_quality_of_a_rare_class(spark, prose):
    rows = [(i, f"{prose(i, 30)} fine words", 1) for i in range(3000)] + [(9000 + i, f"{prose(i, 30)} junk zz qq", 0) for i in range(5)]
    model = quality.fit_quality(spark.createDataFrame(rows, "doc_id long, text string, label int"), max_rows=200)
    told = quality.score_quality(spark.createDataFrame([("alpha beta fine words",), ("alpha beta junk zz qq",)], "text string"), model).collect()
    assert told[0]["__score"] > told[1]["__score"]
    one_class = quality.fit_quality(spark.createDataFrame(rows[:50], "doc_id long, text string, label int"))
    assert all(r["__score"] > 0.9 for r in quality.score_quality(spark.createDataFrame([("x",), ("",)], "text string"), one_class).collect())
