"""Briefs: accepted items, enriched leaders, topics by rule, segments of an issue, descriptions for search engines, stored content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import dates, extract, pages, route
from gleanwork.functions import text as T
from gleanwork.functions.bind import once
from gleanwork.functions.url import contains_any
from gleanwork.operators import dedupe, expand, signals
from gleanwork.operators.checkpoints import materialize

# How many stored items are compared with, lines and characters of an excerpt.
STORED = 2000
EXCERPT_LINES, EXCERPT_CHARS = 6, 1200


def accepted(items: DataFrame, days: int, as_of: Column, strict: bool = True, threshold: float = 0.85, known: DataFrame | None = None) -> DataFrame:
    """Of (seq, title, source, published) the items that stay: fresh, and in order of seq no address and no near-copy of a title that stayed before.

    Freshness is tested first, so a stale item never blocks a later one; a later item of an address enters
    when the earlier ones fell to their titles. ``known`` (title, source): items of earlier runs.
    """
    fresh = items.where((F.coalesce("source", F.lit("")) != "") & dates.is_fresh(F.col("published"), days, as_of, strict))
    before = None if known is None else known.select(F.array("source").alias("keys"), T.scan_tokens(F.col("title")).alias("tokens"))
    stay = dedupe.greedy_distinct(fresh, "seq", F.array("source"), T.scan_tokens(F.col("title")), threshold, before)
    return fresh.join(stay, F.col("seq") == F.col("k"), "left_semi")


def enriched(scored: DataFrame, texts: DataFrame, n: int = 20) -> DataFrame:
    """``scored`` (seq, source, score, ...) with full_text of the first n by score from ``texts`` (url, text); null for the rest."""
    leaders = scored.orderBy(F.desc("score"), "seq").limit(n).select(F.col("seq").alias("__seq"), F.col("source").alias("__url"))
    known = texts.groupBy(F.col("url").alias("__of")).agg(F.max("text").alias("full_text"))
    found = leaders.join(known, F.col("__url") == F.col("__of")).select("__seq", F.nullif("full_text", F.lit("")).alias("full_text"))
    return scored.join(F.broadcast(found), F.col("seq") == F.col("__seq"), "left").drop("__seq")


def rule_topics(scored: DataFrame, k: int, categories: list[tuple[str, list[str]]], other: str = "general") -> DataFrame:
    """The first k by score as topics: the first category of which a term is in the title, and HIGH urgency if dated."""
    low = F.lower(F.coalesce("title", F.lit("")))
    category = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)), name) for name, terms in categories], F.lit(other))
    urgency = F.when(F.col("published").isNotNull(), "HIGH").otherwise("MEDIUM")
    return scored.orderBy(F.desc("score"), "seq").limit(k).select("seq", F.col("title").alias("topic"), category.alias("category"), urgency.alias("urgency"), F.array("source").alias("sources"))


def segments(docs: DataFrame, vendors: list[str], themes: dict[str, list[str]], most: int = 5) -> DataFrame:
    """(doc_id, place, kind, name, excerpt): an issue's topics, one per vendor that its text names, in list order, then themes up to ``most``.

    A vendor is named if its first word stands in the text as a word, a theme if one of
    its terms occurs. The excerpt is the first lines that do so, or the text's beginning.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    rules = [("vendor", v, [v.split()[0]], rf"(?i)\b\Q{v.split()[0]}\E\b") for v in vendors] + [("theme", t, terms, "(?i)" + "|".join(rf"\Q{x}\E" for x in terms)) for t, terms in themes.items()]
    small = lambda x: "".join(c.lower() if c.isascii() else c for c in x)  # noqa: E731  as (?i) sees it in a lower-cased text

    def hits(low: Column) -> Column:
        """The rules that hold; a pattern is tried only where one of its terms stands in the text."""
        hit = lambda kind, name, terms, pattern: F.when(contains_any(low, [small(x) for x in terms]) & low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.array_join(F.slice(F.filter(lines, lambda s: s.rlike(pattern)), 1, EXCERPT_LINES), "\n").alias("excerpt")))
        return F.array_compact(F.array(*[hit(*r) for r in rules]))

    found = F.slice(once(F.lower(F.coalesce("text", F.lit(""))), hits), 1, most)
    each = docs.select("doc_id", F.substring("text", 1, EXCERPT_CHARS).alias("__start"), F.posexplode(found).alias("place", "s"))
    return each.select("doc_id", "place", "s.kind", "s.name", F.coalesce(F.nullif("s.excerpt", F.lit("")), "__start").alias("excerpt"))


def vendor_facts(docs: DataFrame, vendors: list[str], facts: Column, around: int = 150) -> DataFrame:
    """(doc_id, vendor, parameter, value) of facts within ``around`` characters of a vendor's name."""
    named = F.explode(F.filter(F.array(*[F.lit(v) for v in vendors]), lambda v: F.contains(F.lower("text"), F.lower(v))))
    each = docs.select("doc_id", "text", F.explode(facts).alias("f")).select("doc_id", "text", "f", named.alias("vendor"))
    at = F.expr("locate(f.value, text)")
    window = F.substring(F.col("text"), F.greatest(F.lit(1), at - around), 2 * F.lit(around) + F.char_length("f.value"))
    return each.where((at > 0) & F.contains(F.lower(window), F.lower("vendor"))).select("doc_id", "vendor", "f.parameter", "f.value")


def seo_package(title: Column, body: Column, summary: Column, links: list[tuple[str, str]]) -> Column:
    """struct(slug, meta_description, internal_links): a slug of 100 characters, a description, links of the keywords that occur."""
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(u).alias("url")) for k, u in links])
    return F.struct(T.slugify(title, 100).alias("slug"), T.meta_description(body, summary).alias("meta_description"), F.filter(pairs, lambda x: F.contains(F.lower(body), x["keyword"])).alias("internal_links"))


def seo_with_json_ld(title: Column, body: Column, summary: Column, category: Column, links: list[tuple[str, str]], site: str, publisher: str, as_of: Column) -> Column:
    """``seo_package`` with the Article object for search engines, dated as_of."""
    p = seo_package(title, body, summary, links)
    jsonld = T.json_ld(title, p["meta_description"], p["slug"], category, site, publisher, as_of)
    return F.struct(p["slug"].alias("slug"), p["meta_description"].alias("meta_description"), jsonld.alias("jsonld"), p["internal_links"].alias("internal_links"))


def stored_index(news: DataFrame, most: int = STORED) -> DataFrame:
    """(id, title, urls) of the latest stored items (id, title, link, source_url, frontmatter_json): their own URLs and those inside their JSON."""
    latest = news.orderBy(F.desc("id")).limit(most)
    own = F.filter(F.array("link", "source_url"), lambda u: F.coalesce(u, F.lit("")) != "")
    return latest.select("id", "title", F.concat(own, pages.json_urls(F.col("frontmatter_json"))).alias("urls"))


def new_videos(found: DataFrame, known: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Found videos (id, title, upload_date as yyyyMMdd, channel, description) with a date in the window whose url ``known`` (url) lacks."""
    at = F.try_to_date(F.col("upload_date"), "yyyyMMdd")
    shaped = found.where(F.coalesce("id", F.lit("")) != "").select(
        F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "channel",
        F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"), at.alias("published"),
    )
    recent = shaped.where(F.col("published") >= F.to_date(as_of - F.make_dt_interval(F.lit(days))))
    return recent.join(known.select(F.col("url").alias("__known")).distinct(), F.col("url") == F.col("__known"), "left_anti")


def unique_facts(sources: Column) -> Column:
    """The key facts of a topic's sources (array of struct with key_facts), each once, in order."""
    return F.array_distinct(F.flatten(F.transform(sources, lambda s: F.coalesce(s["key_facts"], F.array().cast("array<string>")))))


def parity(rows: DataFrame, kind: str, expected: dict[str, int]) -> DataFrame:
    """(kind, n, expected, matches): counts by kind against what is expected; kinds on either side are listed."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()) or [], "want_kind string, expected long")
    counted = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    both = counted.join(want, F.col("kind") == F.col("want_kind"), "full")
    return both.select(F.coalesce("kind", "want_kind").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"), (F.coalesce("n", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("matches"))


def brief(items: DataFrame, days: int, as_of: Column, k: int, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """Rule-mode topics of (seq, title, snippet, source, feed, published): accepted, scored, capped per source, the first k."""
    kept = accepted(items, days, as_of)
    score = signals.editorial_score(F.concat_ws(" ", "title", "snippet", "feed"), F.col("source"), F.col("feed"), published=F.col("published"), as_of=as_of)
    return rule_topics(signals.diversified(kept.withColumn("score", score), 80), k, categories)


def with_specs(text: Column, facts: Column) -> Column:
    """A text with its measured facts listed below it."""
    listed = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f["parameter"], F.lit(": "), f["value"])), "\n")
    return F.when(F.size(facts) > 0, F.concat_ws("\n\n", text, listed)).otherwise(text)


def build_briefs(
    items: DataFrame, texts: DataFrame, as_of: Column, k: int, categories: list[tuple[str, list[str]]], results: DataFrame | None = None, links: DataFrame | None = None,
    days: int = 30, most_sources: int = 5, least_sources: int = 2,
) -> DataFrame:
    """Rule-mode briefs of signals (seq, title, snippet, source, feed, published): score, enrichment, cap per source, topics, section, sources, corroboration, facts.

    ``texts`` (url, text): landed pages. ``results`` (topic_id, seq, title, url, published, snippet): landed
    searches for topics that have fewer than ``least_sources`` sources. ``links`` (page_url, pos, href,
    title): links of landed pages. One row per topic: topic_id, topic, category, urgency, section,
    section_path, confidence, source_count, sources, key_facts.
    """
    score = signals.editorial_score(F.concat_ws(" ", "title", "snippet", "feed"), F.col("source"), F.col("feed"), published=F.col("published"), as_of=as_of)
    ranked = enriched(items.withColumn("score", score), texts)
    facts = extract.technical_facts(F.col("full_text"))
    ranked = materialize(ranked.withColumn("key_facts", F.transform(facts, lambda f: F.concat(f["parameter"], F.lit(": "), f["value"]))).withColumn("full_text", with_specs(F.col("full_text"), facts)).withColumn("published_at", dates.iso_or_unknown(F.col("published"))))
    shown = signals.diversified(ranked, 80)
    topics = rule_topics(shown, k, categories).withColumnRenamed("seq", "topic_id").drop("sources")
    said = ranked.select(F.col("seq").alias("__s"), "snippet", "source", F.col("published_at").alias("date"), "title")
    topics = materialize(topics.join(said, F.col("topic_id") == F.col("__s")).withColumn("text", F.concat_ws(" ", "topic", "snippet")).drop("__s"))
    section = route.decide(route.scores(route.routed_text(F.col("topic"), F.col("snippet"), F.col("category"))), F.lit(None).cast("string"), F.col("source") != "")
    own = topics.select("topic_id", F.lit(1).cast("long").alias("seq"), "title", F.col("source").alias("url"), "date", F.lit("").alias("fallback"))
    sources = materialize(expand.expanded(topics.select("topic_id", "text"), own, ranked, links, most_sources))
    if results is not None:
        few = sources.groupBy("topic_id").agg(F.count("*").alias("n")).where(F.col("n") < least_sources)
        open_ = topics.select("topic_id", F.col("topic").alias("text")).join(few.select(F.col("topic_id").alias("few"), "n"), F.col("topic_id") == F.col("few"))
        fresh = dates.is_fresh(F.col("published"), days, as_of, False)
        found = expand.corroborating(open_, results, sources.select("topic_id", "url"), fresh, most=least_sources)
        told = results.select(F.col("topic_id").alias("rt"), F.col("seq").alias("rs"), dates.iso_or_unknown(F.col("published")).alias("date"), F.col("snippet").alias("excerpt"))
        more = found.join(told, (F.col("topic_id") == F.col("rt")) & (F.col("seq") == F.col("rs"))).select("topic_id", (most_sources + F.col("place")).alias("place"), "title", "url", "date", F.lit("related_fresh_signal").alias("role"), "excerpt")
        sources = sources.unionByName(more)
    facts_of = ranked.select(F.col("source").alias("fu"), "key_facts").where(F.size("key_facts") > 0)
    with_facts = sources.join(facts_of, F.col("url") == F.col("fu"), "left").select("topic_id", F.struct("place", "title", "url", "date", "role", "excerpt", "key_facts").alias("s"))
    gathered = with_facts.groupBy(F.col("topic_id").alias("t")).agg(F.sort_array(F.collect_list("s")).alias("sources"))  # at most a few per topic
    out = topics.withColumn("d", section).join(gathered, F.col("topic_id") == F.col("t"))
    return out.select(
        "topic_id", "topic", "category", "urgency", "d.section", "d.section_path", "d.confidence", F.size("sources").cast("long").alias("source_count"),
        F.transform("sources", lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"), s["date"].alias("date"), s["role"].alias("role"), s["excerpt"].alias("excerpt"))).alias("sources"), unique_facts(F.col("sources")).alias("key_facts"),
    )


def document_brief(docs: DataFrame, category: str, kind: str = "review", as_of: Column | None = None) -> DataFrame:
    """One topic for each document (title, url, text, company, products, technologies, facts, date): name, angle, section, keywords, facts and its one source."""
    vendor = F.coalesce(F.nullif("company", F.lit("")), F.lit("SMT Equipment Vendor"))
    product = F.try_element_at("products", F.lit(1))
    topic = F.when(product.isNotNull(), F.concat(vendor, F.lit(" "), product, F.lit(": Technical Specifications & Engineering Review"))).otherwise(F.concat(F.lit("Engineering Review: "), "title"))
    stated = F.array_join(F.transform(F.slice("facts", 1, 4), lambda f: F.concat(f["parameter"], F.lit(" = "), f["value"])), "; ")
    angle = F.when(stated != "", F.concat(F.lit("What "), "title", F.lit(" by "), vendor, F.lit(" can do on a line, by its stated values ("), stated, F.lit(")"))).otherwise(F.concat(F.lit("What "), "title", F.lit(" by "), vendor, F.lit(" means for a line")))
    named = F.when(F.size("technologies") > 0, F.col("technologies")).otherwise(F.array(*[F.lit(x) for x in ("SMT", "Electronics Manufacturing", "Quality Control")]))
    keywords = F.slice(F.array_distinct(F.concat(F.array(vendor), named, F.slice("products", 1, 3))), 1, 8)
    facts = F.transform("facts", lambda f: F.concat(f["parameter"], F.lit(": "), f["value"]))
    d = docs.withColumn("topic", topic).withColumn("angle", angle).withColumn("keywords", keywords).withColumn("key_facts", facts)
    text = route.routed_text(F.col("topic"), F.concat_ws("\n", "angle", F.substring("text", 1, 1500)), F.lit(category), F.col("technologies"))
    section = route.decide(route.scores(text), route.normalize_section(F.lit(kind)), F.coalesce("url", F.lit("")) != "")
    source = F.struct("title", "url", dates.iso_or_unknown(F.col("date")).alias("date"), F.lit("primary_pdf_source").alias("role"), F.substring("text", 1, 1800).alias("excerpt"))
    return d.withColumn("d", section).select("url", "topic", "angle", F.lit(category).alias("category"), "d.section", "d.section_path", "keywords", F.lit("HIGH").alias("urgency"), "key_facts", F.array(source).alias("sources"))
