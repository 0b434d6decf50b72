"""Expressions on literal fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import dates, extract, lint, route
from gleanwork.functions import text as T
from gleanwork.functions import url as U
from gleanwork.operators import dedupe, drafts, expand, signals
from gleanwork.sources import landing


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://WWW.Example.com/a/b//?utm_source=x&k=1&empty=&b=2#frag", "http://example.com/a/b?k=1&b=2"),
    ("//host.org/p;v=1", "https://host.org/p"), ("", ""), (None, ""), ("https://a.www.b.com/", "https://a.b.com"), ("http://h/x?q=a+b%20c", "http://h/x?q=a+b+c"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical_url(F.lit(url).cast("string"))) == want


def test_canonical_url_keeps_host(spark):
    assert one(spark, U.canonical_url(F.lit("http://WWW.Ex.com/a/?UTM_x=1"), fold_host=False)) == "http://WWW.Ex.com/a"


@pytest.mark.parametrize("page,href,title,want", [
    ("https://v.com/list", "/news/1", "A new inspection system", True), ("https://v.com/list", "/news/1", "Read more about it", False),
    ("https://v.com/list", "https://other.org/news/1", "A new inspection system", False), ("https://v.com/list", "mailto:x@v.com", "A new inspection system", False),
    ("https://v.com/list", "/product/7", "Plain product page", False), ("https://v.com/list", "/product/7", "We launch a new platform", True),
    ("https://v.com/list", "/support/x", "A new inspection system", False), ("https://v.com/list", "/about", "Nothing of interest", False),
])
def test_link_candidates(spark, page, href, title, want):
    assert one(spark, U.is_link_candidate(F.lit(page), F.lit(href), F.lit(title))) is want


@pytest.mark.parametrize("text,want", [
    ("posted today 2020-01-01", "2024-01-20"), ("Yesterday", "2024-01-19"), ("3 hours ago", "2024-01-19"), ("2 months ago", "2023-11-21"), ("2023-12-05T10:00:00Z", "2023-12-05"),
    ("2023-02-31 but Mar 1st, 2023", "2023-03-01"), ("7 sept. 2023", "2023-09-07"), ("", None), (None, None), ("nothing", None),
])
def test_free_text_dates(spark, text, want):
    as_of = F.lit("2024-01-20 01:00:00").cast("timestamp")
    assert one(spark, F.date_format(dates.parse_any_date(F.lit(text).cast("string"), as_of), "yyyy-MM-dd")) == want


def test_feed_pdf_and_sitemap_dates(spark):
    as_of = F.lit("2024-01-20").cast("timestamp")
    assert one(spark, dates.parse_feed_date(F.lit("Tue, 02 Jan 2024 03:04:05 GMT"), as_of)) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, dates.parse_pdf_date(F.lit("D:20230405120000"), F.lit("May 1, 2020"))) == dt.date(2023, 4, 5)
    assert one(spark, dates.parse_pdf_date(F.lit(""), F.lit("of May 1, 2020"))) == dt.date(2020, 5, 1)
    assert one(spark, dates.parse_pdf_date(F.lit("none"), F.lit("May 1, 2020"))) is None
    assert one(spark, dates.parse_sitemap_date(F.lit("2024-01-02T03:04:05+02:00"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, dates.parse_sitemap_date(F.lit("junk"))) is None


def test_freshness_bounds(spark):
    as_of = F.lit("2024-01-20").cast("timestamp")
    for day, want in (("2024-01-13", True), ("2024-01-12", False), ("2024-01-21", True), ("2024-01-22", False)):
        assert one(spark, dates.within_lookback(F.lit(day).cast("timestamp"), 7, as_of)) is want
    assert one(spark, dates.within_lookback(F.lit(None).cast("timestamp"), 7, as_of)) is False


def test_title_forms(spark):
    assert one(spark, T.title_spaced(F.lit("New X-Ray: 3D!"))) == "new x ray 3d"
    assert one(spark, T.title_deleted(F.lit("New X-Ray: 3D!"))) == "new xray 3d"
    assert one(spark, T.slugify(F.lit("  A -- b c!"), 4)) == "a-b-"
    assert sorted(one(spark, T.title_tokens(F.lit("The new Alpha board of 3D alpha")))) == ["alpha", "board"]


def test_html_to_plain(spark):
    assert one(spark, T.html_to_plain(F.lit("<p>a &amp;  b</p><div>c<br/>d</div>"))) == "a & b\n\nc\nd\n"


def test_meta_description(spark):
    long = "word " * 60
    got = one(spark, T.meta_description(F.lit(long), F.lit("")))
    assert got.endswith("word…") and len(got) <= 158
    assert one(spark, T.meta_description(F.lit("<b>x</b>"), F.lit(""))) == "x"


def test_lenient_json(spark):
    assert one(spark, F.to_json(T.lenient_json(F.lit('```json\n{"a": [1]}\n```')))) == '{"a":[1]}'
    assert one(spark, F.to_json(T.lenient_json(F.lit("no json")))) is None


def test_lint_rules(spark):
    body = "One two three four. " * 8
    codes = one(spark, lint.lint_issues(F.lit("a generic guide"), F.lit(body + "Moreover, it is seamlessly done."), F.lit("insight"), F.array(F.lit("at 3200 cph"))))
    assert [c["code"] for c in codes] == ["banned_phrase", "banned_phrase", "flat_sentence_rhythm", "missing_headings", "too_short", "generic_title", "no_fact_grounding"]
    assert one(spark, lint.threes(F.lit("fast, smart, and good. red, green and blue"))) == 2
    assert one(spark, F.size(lint.paragraph_rhythm(F.lit("\n\n".join(["a b c d"] * 5))))) == 1


@pytest.mark.parametrize("text,explicit,sourced,want", [
    ("supplier profile", None, False, ("vendor", 0.9)), ("x", "review", False, ("review", 0.92)), ("what to verify in aoi", None, False, ("review", 0.88)),
    ("review of the aoi system", None, False, ("review", 0.84)), ("new aoi system series announced", "insight", False, ("review", 0.84)), ("x", "insight", False, ("insight", 0.9)),
    ("how to find the root cause", None, False, ("insight", 0.82)), ("x", "news", False, ("news", 0.86)), ("company appoints ceo", None, False, ("news", 0.78)),
    ("best reflow training", None, False, ("review", 0.78)), ("x", None, True, ("news", 0.62)), ("x", None, False, ("insight", 0.6)),
])
def test_section_rules(spark, text, explicit, sourced, want):
    got = one(spark, route.decide(route.scores(F.lit(text)), F.lit(explicit).cast("string"), F.lit(sourced)))
    assert (got["section"], got["confidence"]) == want


def test_extraction(spark):
    lines = "Speed reaches 12,000 CPH today\nResolution 0.5 um accuracy\nFalse call rate of 2 % only\nRange 0201 - bga parts\nBoard size: 500 x 400 mm\nWeight : 80 kg\nSpeed reaches 12,000 cph"
    got = [(f["parameter"], f["value"]) for f in one(spark, extract.technical_facts(F.lit(lines)))]
    assert ("throughput", "12,000 CPH") in got and ("accuracy", "0.5 um accuracy") in got and ("false_call_rate", "2 %") in got
    assert ("supported_components", "0201 - bga") in got and ("board_size", "500 x 400 mm") in got and ("weight", "80 kg") in got
    assert len({(p.lower(), v.lower()) for p, v in got}) == len(got)
    assert one(spark, extract.technical_facts(F.lit("plain words of praise"))) == []
    assert one(spark, extract.products(F.lit("TR7600 and KY-P3"), F.lit("Zenith II SMT"))) == ["TR7600", "Zenith II", "KY-P3"]
    assert one(spark, extract.document_type(F.lit("A data sheet"), F.lit("catalog"), F.lit(""))) == "datasheet"


def test_duplicate_reasons(spark):
    old = spark.createDataFrame([(1, "Alpha beam scanner line", ["http://a.com/x"]), (2, "Alpha beam: scanner line!", ["http://b.com/y"]), (3, "Gamma ray tube tester deluxe", [])], "id long, title string, urls array<string>")
    new = spark.createDataFrame([(10, "alpha BEAM scanner line", []), (11, "Other words", ["http://none/", "https://www.b.com/y/?utm_a=1"]), (12, "alpha beam  scanner/line", []), (13, "gamma ray tube tester", []), (14, "unlike anything else", [])], "seq long, title string, urls array<string>")
    got = {r["seq"]: (r["reason"], r["matched_id"]) for r in dedupe.find_duplicates(new, old).collect()}
    assert got[10] == ("same_slug", 1) and got[12][0] in ("same_title", "similar_title") and got[13] == ("similar_title", 3) and got[14] == (None, None)
    assert got[11][0] is None or got[11] == ("same_source_url", 2)


def test_greedy_keep_is_not_transitive(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "c e f g"), (4, ""), (5, "a b c d")], "seq long, title string")
    got = {r["seq"]: r["kept"] for r in dedupe.greedy_keep(rows, "seq", T.scan_tokens(F.col("title")), 0.5).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_unique_slugs(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "y"), (5, "x")], "seq long, base string")
    got = {r["seq"]: r["slug"] for r in drafts.unique_slugs(new, spark.createDataFrame([("y",), ("y-2",)], "slug string")).collect()}
    assert got[1] == "x" and got[2] == "x-2" and got[4] == "y-3" and len(set(got.values())) == 5


def test_diversified_and_expand(spark):
    s = spark.createDataFrame([(i, "f" if i < 6 else "", i % 3) for i in range(9)], "seq long, feed string, score int")
    got = [r["seq"] for r in signals.diversified(s, 5, 2).collect()]
    assert got == [2, 5, 8, 7]
    scored = spark.createDataFrame([(1, 1, "http://a/1", 0.9), (1, 2, "http://a/2", 0.8), (1, 3, "http://b/1", 0.5)], "topic_id long, seq long, url string, score double")
    assert [r["seq"] for r in expand.diverse(scored, spark.createDataFrame([(1, "c")], "topic_id long, domain string"), 2).orderBy("place").collect()] == [1, 3]


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><title><![CDATA[A & B smt]]></title><link>http://a/1</link><description>&lt;b&gt;pcb&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>x & y</title><link>http://a/2</link></item></channel></rss>"
    atom = '<feed><entry><title>T smt</title><link href="http://b/1"/><updated>2024-01-05T00:00:00Z</updated></entry></feed>'
    as_of = F.lit("2024-01-10").cast("timestamp")
    items = landing.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("n", None)], "feed string, xml string"), as_of)
    got = {r["source"]: r for r in items.collect()}
    assert got["http://a/1"]["title"] == "A & B smt" and got["http://a/1"]["published"] == dt.datetime(2024, 1, 2, 3, 4, 5) and got["http://b/1"]["title"] == "T smt"
    assert [r["source"] for r in landing.collected(items, 30, as_of, ["smt"]).orderBy("source").collect()] == ["http://a/1", "http://b/1"]
    maps = [("s", "<urlset><url><loc>http://a/news/1</loc><lastmod>2024-01-02</lastmod></url><url><lastmod>2024-01-02</lastmod></url></urlset>"), ("i", '<x:sitemapindex xmlns:x="u"><x:sitemap><x:loc>http://a/m.xml</x:loc></x:sitemap></x:sitemapindex>'), ("bad", "<urlset><url><loc>x")]
    got = {r["loc"]: (r["lastmod"], r["is_index"]) for r in landing.sitemap_urls(spark.createDataFrame(maps, "sitemap string, xml string")).collect()}
    assert got == {"http://a/news/1": (dt.datetime(2024, 1, 2), False), "http://a/m.xml": (None, True)}
    page = '<link rel="alternate" type="application/rss+xml" href="/feed" title=" N "><link rel="stylesheet" type="text/css" href="x"><LINK rel="alternate" type="application/atom+xml" href="http://o/a">'
    got = {(r["feed_url"], r["kind"]) for r in landing.feed_links(spark.createDataFrame([("http://h/p/q", page)], "page string, html string")).collect()}
    assert got == {("http://h/feed", "rss"), ("http://o/a", "atom")}
    assert one(spark, landing.is_feed(F.lit('<?xml version="1.0"?><rss></rss>'))) is True and one(spark, landing.is_feed(F.lit("<html></html>"))) is False


def test_registry_errors(spark):
    rows = [("ok-1", "n", "rss", "https://a", None, None, 5), ("B", None, "odd", "ftp://x", None, None, 11), ("h1", "n", "html", "https://a", None, None, 1), ("v1", "n", "vendor", "https://a", None, None, 1), ("v1", "n", "vendor", "https://a", None, "c", 1)]
    got = [r["errors"] for r in landing.registry_errors(spark.createDataFrame(rows, "id string, name string, source_type string, url string, html_parser string, category string, priority int")).orderBy("id", F.size("errors")).collect()]
    assert got[0] == ["bad id", "no name", "unknown source_type", "bad url", "priority not in 1 to 10"]
    assert ["html without html_parser"] in got and [] in got and ["repeated id", "vendor without category"] in got
