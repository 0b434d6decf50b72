"""Briefs, page expressions, listings and streaming twins on small fixtures."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import extract, pages
from gleanwork.operators import briefs
from gleanwork.sources import landing, listings
from gleanwork.streaming import twins


def as_of(day="2024-01-20"):
    return F.lit(day).cast("timestamp")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_json_urls(spark):
    raw = json.dumps({"a": [{"URL": "http://a/\"q\""}, {"link": {"url": "http://b"}}], "text": '"url": "no"', "source_url": 5, "link": ""})
    assert one(spark, pages.json_urls(F.lit(raw))) == ['http://a/"q"', "http://b"]
    assert one(spark, pages.json_urls(F.lit('{"url": "x"'))) == [] and one(spark, pages.json_urls(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("html,want", [
    ('<meta name="pubdate" content="soon"><meta content="2024-01-02" property="article:modified_time"><time datetime="2024-01-05">', ("2024-01-02", "meta:article:modified_time")),
    ('<script type="application/ld+json">{"x": [{"dateCreated": "2023-12-01"}], "dateModified": "2023-12-05"}</script>', ("2023-12-05", "jsonld")),
    ('<script type="application/ld+json">{broken</script><time datetime="2024-01-05">', ("2024-01-05", "time:datetime")),
    ("<head><title>2020-01-01</title></head><p>Posted Jan 3, 2024</p>", ("2024-01-03", "page_text")), ("<p>none</p>", None), (None, None),
])
def test_page_date(spark, html, want):
    got = spark.createDataFrame([(html,)], "html string").select(pages.page_date(F.col("html"), as_of()).alias("d")).first()["d"]
    assert (None if got is None else (str(got["at"])[:10], got["source"])) == want


def test_front_matter(spark):
    seo = F.struct(F.lit("a-b").alias("slug"), F.lit("m").alias("meta_description"), F.lit('{"@id": "/a-b"}').alias("jsonld"), F.array(F.lit("/x")).alias("internal_links"))
    section = F.struct(F.lit("news").alias("section"))
    got = json.loads(one(spark, pages.front_matter(F.array(F.lit("t")), section, F.lit("http://s"), seo, F.lit("a-b-2"))))
    assert got["seo"]["jsonld"] == '{"@id": "/a-b-2"}' and got["tags"] == ["t"] and got["section_routing"] == {"section": "news"}
    none = F.lit(None).cast("struct<slug: string, meta_description: string, jsonld: string, internal_links: array<string>>")
    assert "seo" not in json.loads(one(spark, pages.front_matter(F.lit(None).cast("array<string>"), section, F.lit(""), none, F.lit("x"))))


def test_writer_prompt(spark):
    kind = "array<struct<title: string, url: string, date: string, role: string, excerpt: string>>"
    df = spark.createDataFrame([([("A", "http://a", None, "fresh_primary", "x" * 600), ("B", "http://b", "2024", "odd", " text "), ("C", "http://c", None, None, None)],)], f"s {kind}")
    got = df.select(pages.writer_prompt(F.lit("T"), F.lit(""), F.array(F.lit("f1")), F.col("s")).alias("p")).first()["p"]
    assert "Source 1: A (primary source, unknown)" in got and "Source 2: B (odd, 2024)" in got and "x" * 551 not in got
    assert "Several sources" in got and "- C http://c" in got and "Angle" not in got


ITEMS = "seq long, title string, snippet string, source string, feed string, published timestamp"


def test_acceptance_and_brief(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, "aoi inspection line", "", "http://a/1", "f", day(1)), (2, "aoi inspection line", "", "http://a/1", "f", day(19)), (3, "AOI inspection line!", "", "http://a/3", "g", day(18)),
        (4, "solder paste tester", "", "http://a/4", "g", None), (5, "reflow oven review", "", "http://a/5", "g", day(20)), (6, "other words", "", None, "g", day(20)),
    ]
    items = spark.createDataFrame(rows, ITEMS)
    assert sorted(r["seq"] for r in briefs.accepted(items, 7, as_of()).collect()) == [2, 5]
    assert sorted(r["seq"] for r in briefs.accepted(items, 7, as_of(), strict=False).collect()) == [2, 4, 5]
    got = briefs.brief(items, 7, as_of(), 5, [("machines", ["oven"]), ("checks", ["inspection"])]).collect()
    assert {(r["seq"], r["category"], r["urgency"]) for r in got} == {(2, "checks", "HIGH"), (5, "machines", "HIGH")}
    assert briefs.accepted(items.limit(0), 7, as_of()).count() == 0


def test_enriched_leaders(spark):
    scored = spark.createDataFrame([(1, "u1", 5), (2, "u2", 9), (3, "u3", 9)], "seq long, source string, score int")
    texts = spark.createDataFrame([("u1", "t1"), ("u2", "t2"), ("u3", "")], "url string, text string")
    assert {r["seq"]: r["full_text"] for r in briefs.enriched(scored, texts, 2).collect()} == {1: None, 2: "t2", 3: None}


def test_segments_and_vendor_facts(spark):
    docs = spark.createDataFrame([(1, "Koh Young shows a line\nplain\nresolution 10 um by koh\nMore on Omron."), (2, None), (3, "solder trends")], "doc_id long, text string")
    got = [(r["doc_id"], r["place"], r["kind"], r["name"]) for r in briefs.segments(docs, ["Omron", "Koh Young", "TRI"], {"solder": ["solder", "paste"]}, 2).orderBy("doc_id", "place").collect()]
    assert got == [(1, 0, "vendor", "Omron"), (1, 1, "vendor", "Koh Young"), (3, 0, "theme", "solder")]
    facts = spark.createDataFrame([(1, "Koh Young: Resolution 0.5 um accuracy" + " x" * 200 + " Omron")], "doc_id long, text string")
    near = briefs.vendor_facts(facts, ["Omron", "Koh Young"], extract.technical_facts(F.col("text"))).collect()
    assert {r["vendor"] for r in near} == {"Koh Young"}


def test_stored_videos_and_parity(spark):
    news = spark.createDataFrame([(1, "a", "http://l", None, '{"url": "http://j"}'), (2, "b", None, "", "broken")], "id long, title string, link string, source_url string, frontmatter_json string")
    assert {r["id"]: r["urls"] for r in briefs.stored_index(news).collect()} == {1: ["http://l", "http://j"], 2: []}
    assert [r["id"] for r in briefs.stored_index(news, 1).collect()] == [2]
    found = spark.createDataFrame([("v1", "t", "20240110", "c", "d" * 300), ("v2", "t", "20230110", "c", None), ("v3", "t", "junk", "c", None), ("v4", "t", "20240111", "c", None), ("", "t", "20240111", "c", None)], "id string, title string, upload_date string, channel string, description string")
    known = spark.createDataFrame([("https://www.youtube.com/watch?v=v4",)], "url string")
    assert [(r["url"][-2:], len(r["description"])) for r in briefs.new_videos(found, known, as_of()).collect()] == [("v1", 200)]
    got = {r["kind"]: (r["n"], r["matches"]) for r in briefs.parity(spark.createDataFrame([("rss",), ("rss",), ("html",)], "k string"), "k", {"rss": 2, "vendor": 1}).collect()}
    assert got == {"rss": (2, True), "html": (1, False), "vendor": (0, False)}
    facts = spark.createDataFrame([([(["a", "b"],), (None,), (["b", "c"],)],)], "s array<struct<key_facts: array<string>>>")
    assert facts.select(briefs.unique_facts(F.col("s")).alias("f")).first()["f"] == ["a", "b", "c"]


def test_listings(spark):
    result = '<div class="result__body"><a rel="x" class="result__a" href="//go/?uddg=http%3A%2F%2Fa%2F1&x=1">A <b>title</b></a><a class="result__snippet" href="y">said Jan 3, 2024</a></div>'
    got = listings.search_results(spark.createDataFrame([("q", result * 2), ("n", None)], "query string, html string"), as_of()).collect()
    assert [(r["title"], r["source"], str(r["published"])[:10]) for r in got] == [("A title", "http://a/1", "2024-01-03")]
    page = '<div><h2><a href="/n/1">A heading here</a></h2><p>2024-01-05 words</p></div><h3><a href="/n/2">short</a></h3><h3>no link at all</h3>'
    got = listings.listed_items(spark.createDataFrame([("f", "http://h/p", page)], "feed string, page string, html string"), as_of()).collect()
    assert [(r["title"], r["source"], r["snippet"], str(r["published"])[:10]) for r in got] == [("A heading here", "http://h/n/1", "2024-01-05 words", "2024-01-05")]
    vendor = '<ul><li><a href="/news/1">We launch a platform</a> 2024-01-06</li><li><a href="/privacy">Privacy and more</a></li></ul>'
    got = listings.vendor_items(spark.createDataFrame([("v", "http://h/p", vendor)], "feed string, page string, html string"), as_of()).collect()
    assert [(r["source"], str(r["published"])[:10]) for r in got] == [("http://h/news/1", "2024-01-06")]


def test_registry_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss/a.yaml").write_text("- {id: ok-1, name: n, source_type: rss, url: 'https://a'}\n- {id: ok-2, name: n, source_type: rss, url: 'https://b', odd: 1}\n")
    (tmp_path / "one.yml").write_text("id: v1\nname: n\nsource_type: vendor\nurl: https://c\npriority: 11\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    rows = listings.registry_files(spark, f"file://{tmp_path}")
    got = {(r["id"], r["error"]) for r in rows.collect()}
    assert got == {("ok-1", None), ("ok-2", "unknown field odd"), ("v1", None), (None, "not YAML")}
    errors = {r["id"]: r["errors"] for r in landing.registry_errors(rows.where("error IS NULL")).collect()}
    assert errors == {"ok-1": [], "v1": ["priority not in 1 to 10", "vendor without category"]}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"http://www.h/{i % 3}", "f" if i % 2 else "g", dt.datetime(2024, 1, 1, i)) for i in range(12)]
    batch = spark.createDataFrame(rows, "seq long, url string, feed string, at timestamp")
    batch.coalesce(1).write.parquet(f"file://{tmp_path}/in")

    def drained(df, mode):
        name = f"t{uuid.uuid4().hex}"
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    stream = lambda: spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    since = F.lit("2024-01-01 06:00:00").cast("timestamp")
    assert drained(twins.fresh(stream(), "at", since), "append").count() == twins.fresh(batch, "at", since).count() == 6
    assert {r["canonical"] for r in drained(twins.first_of_url(stream(), F.col("url"), "at", "1 day"), "append").collect()} == {"http://h/0", "http://h/1", "http://h/2"}
    counted = drained(twins.feed_counts(stream(), "feed", "at", "1 day", "1 day", F.col("seq") > 5), "complete").collect()
    assert {(r["feed"], r["seen"], r["kept"]) for r in counted} == {("f", 6, 3), ("g", 6, 3)}
