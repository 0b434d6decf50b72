"""The term index against searches by pattern."""

import random
import re

from pyspark.sql import functions as F

from gleanwork.functions import route, terms
from gleanwork.plans import document_queries as D

TABLES = [D.TEST_REVIEW, D.TEST_INSIGHT, D.TEST_NEWS, D.TEST_VENDOR, [(p, 1) for p in D.TEST_EQUIPMENT], [(p, 1) for p in D.TEST_PRODUCT], [(p, 1) for p in D.TEST_BUYER]]
ODD = [(r"\bbest\b|\btop\s+\d+\b", 1), (r"plain", 1), (r"\b[ab]c\b", 1), (r"\bx-?y(?:s|es)?\b", 1), (r"\bé\b", 1), (r"\bends\.\b", 1), (r"\bq\b", 1)]


def test_patterns_are_compiled():
    assert terms.compiled(r"\blaunch(?:es|ed)?\b|\bnew\b") == terms.Compiled(("launch", "launched", "launches", "new"), (), ())
    assert terms.compiled(r"\bvs\.?\b") == terms.Compiled(("vs",), (), ())
    phrase = terms.compiled(r"\babout\s+the\s+(company|vendor)\b|\bx-?ray\b")
    assert phrase.words == ("xray",) and [w for w, _ in phrase.phrases] == [("about", "the", "company"), ("about", "the", "vendor"), ("x", "ray")] and not phrase.others
    assert terms.compiled(r"\btr\d+\b|\bnew\b") == terms.Compiled(("new",), (), (("tr", r"\btr\d+\b"),))
    assert terms.compiled(r"\w+\s\d").others == ((None, r"\w+\s\d"),) and terms.compiled("[ab]c").others == ((None, "[ab]c"),)
    plain = [p for t in TABLES for p, _ in t for a in terms.alternatives(p) if "\\d" not in a]
    assert all(not [o for o in terms.compiled(p).others if "\\d" not in o[1]] for p in plain)


def test_what_any_other_alternative_needs_is_in_its_matches():
    found = "a review vs. the buyer  guide launched x-ray tr500 cv-3 mx-12 top 5 spare part questions to ask before shortlisting hires"
    for pattern in (p for t in TABLES for p, _ in t):
        for needed, other in terms.compiled(pattern).others:
            assert needed is None or not re.search(other, found) or needed in found


def test_index_finds_what_searches_find(spark):
    draw = random.Random(3)
    parts = [re.sub(r"\\b|\\s\+|\\d\+|\(\?:[^)]*\)\??|\\\.\?|\?", lambda m: {"\\s+": draw.choice([" ", "  ", "\n"]), "\\d+": "42"}.get(m.group(), ""), a) for t in [*TABLES, ODD] for p, _ in t for a in terms.alternatives(p)]
    joints = [" ", "  ", "\t", "\n", "-", ".", ", ", "_", "é", "", "x", "2"]
    texts = ["", "vs.", "vs.x", "xvs", "tr", "tr5", "tr٣", "x ray", "x--ray", "x-ray", "xrays", "about  the\nvendor", "bestbest best", "ends.x", "q", "é", "naïve best"]
    texts += ["".join(x for _ in range(draw.randrange(1, 12)) for x in (draw.choice(parts), draw.choice(joints))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    low = F.lower("text")
    told = rows.select("id", *[route.weighted_hits(low, t).alias(f"t{i}") for i, t in enumerate([*TABLES, ODD])], *[route.weighted_score(low, t).alias(f"s{i}") for i, t in enumerate([*TABLES, ODD])])
    for r in told.collect():
        text = texts[r["id"]].lower()
        for i, t in enumerate([*TABLES, ODD]):
            want = [(p, w) for p, w in t if re.search(p, text)]
            assert r[f"t{i}"] == [p for p, _ in want], (text, i)
            assert r[f"s{i}"] == sum(w for _, w in want)
