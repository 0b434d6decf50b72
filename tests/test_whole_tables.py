"""Queries over all rows and whole texts against brute force on small tables."""

import os
import re

import duckdb
import pytest

from gleanwork.functions import lint
from gleanwork.functions import text as T
from gleanwork.plans import document_queries as D
from gleanwork.plans import page_queries, registry, table_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "Café news of the day, été and naïve résumé. A1, bé and cé", "fr", "s"), (2, None, "en", "s"), (3, "“Curly” ÉAB thon 5é and 12 % of “it”. " + "word " * 80 + "12 % là", "en", "s"),
    (4, "plain words only, one, two and three, four, five and six", "en", None), (5, "eé ther thon, léa, né and ça, pâ, mé and tü; thoné therß", "de", "s"), (6, "", None, "s"),
]


@pytest.fixture
def docs(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, *_ in TEXTS], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def told(spark, name, at):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, at).collect()}


NINE = "lint_rule_of_three lint_title lint_grounding lint_report_score quality_gate section_scores section_decision entities seo_package".split()


@pytest.mark.parametrize("name", NINE)
def test_every_document_has_a_row(spark, docs, name):
    got = told(spark, name, docs)
    assert set(got) == {i for i, *_ in TEXTS} and all(v is not None for r in got.values() for v in r)


def test_non_ascii_texts_against_brute_force(spark, docs):
    threes, titles, grounding, scores = (told(spark, n, docs) for n in ("lint_rule_of_three", "lint_title", "lint_grounding", "section_scores"))
    for i, text, *_ in TEXTS:
        t = text or ""
        assert threes[i]["flagged"] == (len(re.findall(lint.RULE_OF_THREE.replace("(?iU)", "(?i)"), t)) >= 2)
        later = [w for w in t[:60].split()[1:] if w[0].isupper() and w.strip(".,:").lower() not in lint.GENERIC_TITLE_WORDS]
        assert titles[i]["specific"] == bool(re.search(r"\d|\b[A-Z]{2,}\b", t[:60]) or later)
        number = re.compile(lint.NUMBER.replace("(?U)", ""))
        wanted = set(number.findall(t))
        assert grounding[i]["ungrounded"] == bool(wanted and not wanted & set(number.findall(t[300:])))
        assert scores[i]["review"] == sum(w for p, w in D.TEST_REVIEW if re.search(p, t.lower()))
        assert scores[i]["product"] == any(re.search(p, t.lower()) for p in D.TEST_PRODUCT)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["lint_rule_of_three", "lint_title", "section_scores", "seo_package"])
def test_rows_of_the_sql_are_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    sql = con.sql(registry.SQL[name])
    mine = {tuple(r[c] for c in sql.columns) for r in df.collect()}
    assert set(sql.fetchall()) == mine


def test_every_page_is_a_topic(spark, tmp_path):
    at = f"file://{tmp_path}"
    words = "solder reflow stencil placement inspection voids nozzle feeder".split()
    page = lambda i: f"<title>{' '.join(words[i % 5 : i % 5 + 4])}</title><p>{words[-i % 8]} item{i}</p>"
    rows = [(i, f"https://host{i % 3}.example/{i}", page(i)) for i in range(1, 13)] + [(13, "https://host1.example/13", "<p>no title</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    sets = {i: set(re.findall(r"[a-z0-9-]{3,}", re.sub(r"<[^>]*>", " ", html).lower())) - set(T.TOPIC_STOPS) for i, _, html in rows[:-1]}
    host = {i: url.split("/")[2] for i, url, _ in rows}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            score = len(x & y) / min(len(x), len(y))
            if 0.28 <= score < 0.97:
                want[a, b] = round(score, 6)
    got = {(r["topic_id"], r["seq"]): r["score"] for r in registry.QUERIES["source_expansion"](spark, at).collect()}
    assert got == want and len({a for a, _ in got}) == 12
    picks = set()
    for a in sets:
        scored = sorted((-v, b) for (t, b), v in want.items() if t == a)
        first = {}
        for v, b in scored:
            if host[b] != host[a]:
                first.setdefault(host[b], b)
        order = sorted(scored, key=lambda s: (first.get(host[s[1]]) != s[1], s))
        picks |= {(a, b, host[b], n) for n, (_, b) in enumerate(order[:4], 1)}
    assert {(r["topic_id"], r["seq"], r["domain"], r["place"]) for r in registry.QUERIES["domain_diverse_pick"](spark, at).collect()} == picks


def test_whole_texts_and_all_rows(spark, docs):
    long = "aaa " + "filler " * 400 + "zzzlast 42 "
    spark.createDataFrame([(9, long, "fr", "s")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(f"{docs}/documents.parquet")
    assert set(told(spark, "topic_token_sets", docs)) == {*(i for i, *_ in TEXTS), 9}
    assert told(spark, "topic_token_sets", docs)[9]["tokens"] == "aaa filler zzzlast"
    assert not told(spark, "lint_grounding", docs)[9]["ungrounded"]
    spark.createDataFrame([(10, "9 " + "filler " * 300 + "8", "fr", "s")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(f"{docs}/documents.parquet")
    assert told(spark, "lint_grounding", docs)[10]["ungrounded"] is False  # 8 stands beyond 2,000 characters


def test_places_over_all_rows(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.range(1, 1001).selectExpr("id AS o_orderkey").repartition(7).write.parquet(f"{at}/orders.parquet")
    order = [7, *(k for k in range(1, 1001) if k != 7)]
    assert {r["o_orderkey"]: r["idx"] for r in registry.QUERIES["move_to_front"](spark, at).collect()} == {k: n for n, k in enumerate(order)}
    texts = [(i, "solder " * (i % 3 == 0) + "yield " * (i % 7 == 0), "en", "s") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{at}/documents.parquet")
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in registry.QUERIES["ranked_signals"](spark, at).collect())
    assert [r[0] for r in got] == list(range(1, 301))
    assert [r[1] for r in got] == [i for _, i in sorted((-s, i) for _, i, s in got)]
    pages = [(1, "u", "<h1>A &amp; B</h1>"), (2, "u", "<title>Only a title</title>"), (3, "u", "<h1>Plain</h1>"), (4, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    titles = {r["page_id"]: r["title"] for r in registry.QUERIES["page_titles"](spark, at).collect()}
    assert titles == {1: "A & B", 2: "Only a title", 3: "Plain", 4: ""}


def test_inserted_drafts_are_numbered_in_order(spark):
    from gleanwork.operators import drafts

    old = spark.createDataFrame([(5, "x", True)], "id long, t string, is_published boolean")
    new = spark.createDataFrame([(i, f"t{i}") for i in range(50, 0, -1)], "seq long, t string").repartition(6)
    got = drafts.insert(old, new)
    assert {r["t"]: r["id"] for r in got.collect()} == {"x": 5, **{f"t{i}": 5 + i for i in range(1, 51)}}


def test_ordinary_pages(spark, tmp_path):
    at = f"file://{tmp_path}"
    pages = [
        (1, "https://h.example/a", "<nav><p>menu</p></nav><div class='x post-body y'><div>pic</div><p>One.</p><p>Two <b>b</b>.</p></div><p>after</p>"),
        (2, "https://h.example/b", "<header><p>top</p></header><!-- <article> --><p>All of it.</p><form><p>name</p></form><p>And more.</p>"),
        (3, "https://h.example/c", "<article><aside><p>side</p></aside><p>In.</p><article><p>Inner.</p></article><p>Last.</p></article><p>out</p>"),
        (4, "https://h.example/d", None), (5, "https://h.example/e", "<article class=x><p>Never closed.</p>"),
    ]
    anchors = "<a class=x href='/news/new-launch'>New <b>launch</b> of it</a><a href=\"/doc\" title='PDF data'>Sheet</a><A target=_blank HREF=/x.pdf?v=1>file</A><a href=\"/get\">Manual (PDF)</a><a href='/t.pdf'>Terms of use</a><a data-href='/no'>no</a><a href='#pdf'>pdf here</a>"
    spark.createDataFrame([*pages, (6, "https://h.example/f", anchors)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    run = lambda n: registry.QUERIES[n](spark, at).collect()
    texts = {r["page_id"]: r["text"] for r in run("html_main_text")}
    assert texts == {1: "One. Two b.", 2: "All of it. And more.", 3: "In. Inner. Last.", 4: "", 5: "Never closed.", 6: ""}
    leaders = {r["seq"]: r["full_text"] for r in run("enriched_leaders")}
    assert leaders[1] == "One. Two b." and leaders[2] == "All of it. And more."
    assert {r["pos"]: r["candidate"] for r in run("link_candidates")} == {i: i in (0, 4) for i in range(6)}  # a path with .pdf is a hint
    assert [tuple(r) for r in run("pdf_links")] == [(6, 6, 3)]
