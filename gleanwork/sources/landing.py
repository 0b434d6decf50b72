"""Landed payloads to rows: feeds, sitemaps, feed links, PDFs' signals, registries.

Fetching is a landing job's work and no part of a query: payloads are columns here.
XML is parsed by Spark's own reader functions where it is well formed; a bare & is
repaired before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions import dates
from gleanwork.functions import text as T
from gleanwork.functions import url as U

# Media types of feeds, and the rules of a source registry.
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/x.atom+xml", "application/x-atom+xml"]
SOURCE_TYPES = ["rss", "vendor", "html", "youtube"]
TRUST_LEVELS = ["official_vendor", "industry_media", "aggregator", "unknown"]
HTML_PARSERS = ["smtnet_news", "generic_dated_list"]
SOURCE_ID, LONGEST_URL = r"^[a-z0-9][a-z0-9-]{1,79}$", 2083
TRACKED = r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;)"


def repaired(xml: Column) -> Column:
    """Bare ampersands escaped."""
    return F.regexp_replace(F.coalesce(xml, F.lit("")), TRACKED, "&amp;")


def child(block: Column, *names: str) -> Column:
    """The first of these child elements that holds text, whatever its namespace prefix; CDATA unwrapped, trimmed, decoded."""
    found = []
    for name in names:
        inner = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}\s*>", 1)
        found.append(F.nullif(F.trim(T.decode_entities(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(" \n\t\r")), F.lit("")))
    return F.coalesce(*found)


def _items(feeds: DataFrame, most: int) -> DataFrame:
    """The first items (pos, b) of RSS or Atom payloads, with the feeds' other columns."""
    xml = repaired(F.col("xml"))
    rss = F.regexp_extract_all(xml, F.lit(r"(?is)<item(?:\s[^>]*)?>.*?</item\s*>"), F.lit(0))
    atom = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?entry(?:\s[^>]*)?>.*?</(?:\w+:)?entry\s*>"), F.lit(0))
    blocks = F.slice(F.when(F.size(rss) > 0, rss).otherwise(atom), 1, most)
    return feeds.select(*[c for c in feeds.columns if c != "xml"], F.posexplode(blocks).alias("pos", "b"))


def feed_items(feeds: DataFrame, as_of: Column, per_feed: int = 20) -> DataFrame:
    """feed, pos, title, source, snippet, published of the first items of RSS or Atom payloads (feed, xml)."""
    each = _items(feeds, per_feed)
    href = F.nullif(F.regexp_extract("b", r"(?is)<(?:\w+:)?link\b[^>]*\bhref=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return each.select(
        "feed", "pos", child(F.col("b"), "title").alias("title"), F.coalesce(child(F.col("b"), "link"), href).alias("source"),
        T.strip_tags(child(F.col("b"), "description", "summary", "content"), 350).alias("snippet"),
        dates.parse_feed_date(child(F.col("b"), "pubDate", "published", "updated", "date"), as_of).alias("published"),
    )


def search_feed_items(landed: DataFrame, as_of: Column, most: int = 8) -> DataFrame:
    """query, pos, title, snippet, source, feed, date_source, published of the first items of search feeds (query, xml); the feed is named by the item's own source."""
    named = F.coalesce(child(F.col("b"), "source"), F.lit(""))
    return _items(landed, most).select(
        "query", "pos", child(F.col("b"), "title").alias("title"), T.strip_tags(child(F.col("b"), "description"), 350).alias("snippet"), child(F.col("b"), "link").alias("source"),
        F.concat(F.lit("GoogleNews:"), named).alias("feed"), F.lit("google_news_rss").alias("date_source"), dates.parse_feed_date(child(F.col("b"), "pubDate"), as_of).alias("published"),
    )


def collected(items: DataFrame, days: int, as_of: Column, terms: list[str], strict: bool = True) -> DataFrame:
    """Items with title and address that are relevant and fresh, one per address: the first."""
    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    kept = items.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != "") & U.contains_any(low, terms) & dates.is_fresh(F.col("published"), days, as_of, strict))
    first = F.row_number().over(Window.partitionBy("source").orderBy("feed", "pos"))
    return kept.withColumn("__n", first).where("__n = 1").drop("__n")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """sitemap, loc, lastmod, is_index of urlset and sitemapindex payloads (sitemap, xml); entries without loc are left out, other payloads give nothing."""
    xml = repaired(F.col("xml"))
    index = xml.rlike(r"(?is)<(?:\w+:)?sitemapindex\b")
    pattern = r"(?is)<(?:\w+:)?{0}(?:\s[^>]*)?>.*?</(?:\w+:)?{0}\s*>"
    blocks = F.when(index, F.regexp_extract_all(xml, F.lit(pattern.format("sitemap")), F.lit(0))).otherwise(F.regexp_extract_all(xml, F.lit(pattern.format("url")), F.lit(0)))
    closed = xml.rlike(r"(?is)</(?:\w+:)?(urlset|sitemapindex)\s*>\s*$")
    each = sitemaps.where(closed).select("sitemap", index.alias("is_index"), F.explode(blocks).alias("b"))
    return each.select("sitemap", child(F.col("b"), "loc").alias("loc"), dates.parse_sitemap_date(child(F.col("b"), "lastmod")).alias("lastmod"), "is_index").where("loc IS NOT NULL")


def recent_first(urls: DataFrame) -> DataFrame:
    return urls.orderBy(F.desc_nulls_last("lastmod"), "loc")


def feed_links(pages: DataFrame) -> DataFrame:
    """page, feed_url, title, kind of the feeds that pages (page, html) advertise, each address once."""
    tags = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))).alias("pos", "tag"))
    attr = lambda name: F.regexp_extract("tag", rf"(?i)\b{name}=[\"']([^\"']*)[\"']", 1)
    mime = F.lower(F.trim(attr("type")))
    rel = F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "alternate")
    found = tags.where(rel & mime.isin(FEED_TYPES) & (attr("href") != "")).select("page", "pos", U.resolve(F.col("page"), attr("href")).alias("feed_url"), F.trim(attr("title")).alias("title"), F.when(mime.contains("atom"), "atom").otherwise("rss").alias("kind"))
    first = F.row_number().over(Window.partitionBy("page", "feed_url").orderBy("pos"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n", "pos")


def is_feed(xml: Column) -> Column:
    """Whether the payload's root element is a feed's and is closed."""
    root = F.lower(F.regexp_extract(F.coalesce(xml, F.lit("")), r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([\w:.-]+)", 1))
    closed = F.lower(xml).rlike(r"(?s)</[\w:.-]+>\s*$") & (F.lower(F.regexp_extract(xml, r"(?s)</([\w:.-]+)\s*>\s*$", 1)) == root)
    return F.coalesce((root.endswith("rss") | root.endswith("feed") | root.contains("rdf")) & closed, F.lit(False))


def document_signals(documents: DataFrame, facts: Column) -> DataFrame:
    """Parsed documents (title, url, text, date) as signals: a snippet with the first four facts, a full text with all."""
    shown = F.array_join(F.transform(F.slice(facts, 1, 4), lambda f: F.concat(f["parameter"], F.lit(": "), f["value"])), "; ")
    every = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f["parameter"], F.lit(": "), f["value"])), "\n")
    body = T.title_collapsed(F.col("text"))
    return documents.select(
        "title", F.col("url").alias("source"), F.trim(F.concat_ws(" ", F.substring(body, 1, 350), F.nullif(shown, F.lit("")))).alias("snippet"),
        F.concat_ws("\n\n", F.substring(body, 1, 1800), F.nullif(every, F.lit(""))).alias("full_text"), T.content_hash(F.col("text")).alias("text_hash"),
        dates.iso_or_unknown(F.col("date")).alias("published_at"), F.size(facts).alias("n_facts"),
    )


def registry_errors(sources: DataFrame) -> DataFrame:
    """``sources`` with the array of rules each row breaks, repeated ids among them.

    A source: id, name, source_type, url, html_parser, category, priority and perhaps trust_level. Rows without source_type that
    have a query are search queries: id and query are all they need.
    """
    has = lambda c: c in sources.columns
    is_query = F.col("source_type").isNull() & F.col("query").isNotNull() if has("query") else F.lit(False)
    repeated = sources.where("id IS NOT NULL").groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"))
    joined = sources.join(repeated, F.col("id") == F.col("__id"), "left")
    known = lambda c, names: F.col(c).isNull() | F.col(c).isin(names)
    source_rules = [
        (F.col("name").isNull(), "no name"),
        (~F.coalesce(F.col("source_type").isin(SOURCE_TYPES), F.lit(False)), "unknown source_type"),
        (~F.coalesce(F.col("url").rlike(r"(?i)^https?://[^\s/?#]+(?:[/?#]\S*)?$") & (F.char_length("url") <= LONGEST_URL), F.lit(False)), "bad url"),
        (~F.coalesce(F.col("priority").between(1, 10), F.lit(False)), "priority not in 1 to 10"),
        (~known("html_parser", HTML_PARSERS), "unknown html_parser"),
        (~known("trust_level", TRUST_LEVELS) if has("trust_level") else F.lit(False), "unknown trust_level"),
        ((F.col("source_type") == "html") & F.col("html_parser").isNull(), "html without html_parser"),
        ((F.col("source_type") == "vendor") & (F.coalesce("category", F.lit("")) == ""), "vendor without category"),
    ]
    rules = [(~F.coalesce(F.col("id").rlike(SOURCE_ID), F.lit(False)), "bad id"), (F.col("__n") > 1, "repeated id"), *((~is_query & broken, name) for broken, name in source_rules)]
    if has("query"):
        rules.append((is_query & (F.trim("query", F.lit(" \t\n\r")) == ""), "empty query"))
    errors = F.filter(F.array(*[F.when(broken, name) for broken, name in rules]), lambda e: e.isNotNull())
    return joined.select(*sources.columns, errors.alias("errors"))


def registry_strict(sources: DataFrame) -> DataFrame:
    """``sources`` if none of them breaks a rule; else reading the result fails, naming a row and its errors."""
    told = registry_errors(sources)
    message = F.concat(F.lit("source "), F.coalesce("id", F.lit("without id")), F.lit(": "), F.array_join("errors", ", "))
    return told.where(F.when(F.size("errors") > 0, F.raise_error(message).cast("boolean")).otherwise(True)).select(*sources.columns)


def document_input(files: DataFrame, landed: DataFrame) -> DataFrame:
    """(url, title, text) of documents given as files, and of landed ones whose address no file has."""
    known = files.select(F.col("url").alias("__url")).distinct()
    return files.select("url", "title", "text").unionByName(landed.select("url", "title", "text").join(known, F.col("url") == F.col("__url"), "left_anti"))


def configured(spark: SparkSession, setting: str, registry: list[tuple], builtin: list[tuple]) -> DataFrame:
    """name, url, group from a setting 'Name|url[|group];…', else the registry, else the built-in list: the first that isn't empty."""
    parts = [tuple(x.strip() for x in entry.split("|")) for entry in (setting or "").split(";") if "|" in entry]
    chosen = [p for p in parts if len(p) > 1 and p[0] and p[1]] or registry or builtin
    return spark.createDataFrame([(*p, None)[:3] if len(p) < 3 else p[:3] for p in chosen], "name string, url string, `group` string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def discovered_feeds(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """page, feed_url, title, kind, method: the feeds that pages (page, html) advertise; for pages without one, the probed common addresses (page, candidate, xml) that hold a feed."""
    told = feed_links(pages).withColumn("method", F.lit("link_tag"))
    silent = probes.join(told.select(F.col("page").alias("__p")).distinct(), F.col("page") == F.col("__p"), "left_anti").where(is_feed(F.col("xml")))
    return told.unionByName(silent.select("page", F.col("candidate").alias("feed_url"), F.lit("").alias("title"), F.lit("rss").alias("kind"), F.lit("common_path_probe").alias("method")))


def discovered_news(sitemaps: DataFrame, children: DataFrame, most_children: int = 5, most: int = 10) -> DataFrame:
    """sitemap, place, loc, lastmod: each site's most recent news-like addresses, from its sitemap (sitemap, xml) or, if that is an index, from its first child sitemaps (loc, xml)."""
    entries = sitemap_urls(sitemaps.select("sitemap", "xml"))
    order = Window.partitionBy("sitemap").orderBy("loc")
    first = entries.where("is_index").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_children).select(F.col("sitemap").alias("of"), F.col("loc").alias("child"))
    inside = sitemap_urls(children.select(F.col("loc").alias("sitemap"), "xml")).where("NOT is_index")
    merged = inside.join(first, F.col("sitemap") == F.col("child")).select(F.col("of").alias("sitemap"), "loc", "lastmod")
    news = entries.where("NOT is_index").select("sitemap", "loc", "lastmod").unionByName(merged).where(U.is_news_like(F.col("loc")))
    place = F.row_number().over(Window.partitionBy("sitemap").orderBy(F.desc_nulls_last("lastmod"), "loc"))
    return news.withColumn("place", place).where(F.col("place") <= most).select("sitemap", "place", "loc", "lastmod")
