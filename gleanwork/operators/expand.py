"""Sources for topics: lookup by URL, similarity with bounds, picks from different domains, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import text as T
from gleanwork.functions import url as U
from gleanwork.functions.bind import once
from gleanwork.operators.dedupe import similar_pairs

# Hosts and paths that no context link leads to, and words in paths of products.
SOCIAL_HOSTS = ["twitter.com", "x.com", "linkedin.com", "facebook.com", "mailto"]
NAVIGATION_PATHS = ["/category/", "/tag/", "/subscribe", "/contact", "/privacy", "/terms", "/go/", "/share", "/intent/"]
PRODUCT_PATHS = ["product", "solution", "aoi", "spi", "axi", "x-ray", "xray", "zenith", "tr7600"]
SAME_HOST_LEAST = 0.55


def excerpts(sources: DataFrame, signals: DataFrame) -> DataFrame:
    """Sources (url, fallback) with the excerpt of the signal of that canonical URL: full text, snippet or fallback; the last signal wins."""
    full = F.nullif(F.col("full_text"), F.lit("")) if "full_text" in signals.columns else F.lit(None).cast("string")
    known = signals.groupBy(U.canonical_url(F.col("source"), fold_host=False).alias("cu")).agg(F.max_by(F.struct(full.alias("full"), F.col("snippet").alias("snippet")), "seq").alias("s"))
    text = F.substring(F.trim(F.coalesce("s.full", F.nullif(F.col("s.snippet"), F.lit("")), "fallback", F.lit(""))), 1, 600)
    return sources.join(known, U.canonical_url(F.col("url"), fold_host=False) == F.col("cu"), "left").withColumn("excerpt", text).drop("cu", "s")


def related(topics: DataFrame, signals: DataFrame, low: float = 0.28, high: float = 0.97, taken: DataFrame | None = None, room: int | None = None) -> DataFrame:
    """(topic_id, seq, score) of signals similar to topics (topic_id, text, has_primary); near-copies count only without a primary source.

    With ``room``, of each topic only some, among them all that ``diverse(..., taken, room)`` picks.
    """
    below = F.when(F.col("has_primary"), high).when(~F.col("has_primary"), float("inf")).otherwise(high)
    t = topics.select(F.col("topic_id").alias("id"), T.topic_tokens(F.col("text")).alias("tokens"), below.alias("below"))
    s = signals.where("title <> '' AND source <> ''").select(F.col("seq").alias("id"), T.topic_tokens(F.concat_ws(" ", "title", "snippet")).alias("tokens"), U.host(F.col("source")).alias("label"))
    if room is not None:
        held = taken.groupBy(F.col("topic_id").alias("t")).agg(F.collect_set("domain").alias("held"))
        t = t.join(held, F.col("id") == F.col("t"), "left").drop("t")
    return similar_pairs(t, s, low, room).select(F.col("a").alias("topic_id"), F.col("b").alias("seq"), "score")


def diverse(scored: DataFrame, taken: DataFrame, room: int | None) -> DataFrame:
    """Picks of (topic_id, seq, url, score): first the best of each domain that ``taken`` (topic_id, domain) lacks, then the best of the rest; without ``room`` all, in that order."""
    named = scored.withColumn("domain", U.host(F.col("url")))
    seen = taken.select(F.col("topic_id").alias("t"), F.col("domain").alias("d"), F.lit(True).alias("seen")).distinct()
    joined = named.join(seen, (F.col("topic_id") == F.col("t")) & (F.col("domain") == F.col("d")), "left")
    best = F.row_number().over(Window.partitionBy("topic_id", "domain").orderBy(F.desc("score"), "seq"))
    phased = joined.withColumn("phase", F.when(F.col("seen").isNull() & (best == 1), 1).otherwise(2))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("phase", F.desc("score"), "seq"))
    placed = phased.withColumn("place", place).select("topic_id", "seq", "url", "domain", "score", "phase", "place")
    return placed if room is None else placed.where(F.col("place") <= room)


def appended(sources: DataFrame) -> DataFrame:
    """Sources (topic_id, phase, seq, title, url, date, role, excerpt) without repeated canonical URLs, the first kept, with defaults filled in."""
    c = sources.withColumn("cu", U.canonical_url(F.col("url"), fold_host=False)).where("cu <> ''")
    first = F.row_number().over(Window.partitionBy("topic_id", "cu").orderBy("phase", "seq"))
    kept = c.withColumn("n", first).where("n = 1")
    return kept.select(
        "topic_id", "phase", "seq", F.coalesce(F.nullif(T.title_collapsed(F.col("title")), F.lit("")), F.col("cu")).alias("title"), F.col("cu").alias("url"),
        F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit("unknown")).alias("date"), F.coalesce("role", F.lit("source")).alias("role"),
        F.substring(F.trim(F.coalesce("excerpt", F.lit(""))), 1, 600).alias("excerpt"),
    )


def corroborating(topics: DataFrame, results: DataFrame, have: DataFrame, fresh: Column, least: float = 0.22, most: int = 3) -> DataFrame:
    """Landed search results (topic_id, seq, title, url) for topics (topic_id, text) whose URL isn't in ``have`` (topic_id, url): similar, fresh, the first ``most``."""
    known = have.select(F.col("topic_id").alias("t"), U.canonical_url(F.col("url")).alias("h")).distinct()
    c = results.where(fresh).withColumn("cu", U.canonical_url(F.col("url")))
    unseen = c.join(known, (F.col("topic_id") == F.col("t")) & (F.col("cu") == F.col("h")), "left_anti")
    told = unseen.join(topics.select(F.col("topic_id").alias("tt"), "text"), F.col("topic_id") == F.col("tt"))
    close = told.where(T.overlap(T.title_tokens(F.col("text")), T.title_tokens(F.col("title"))) >= least)
    one = close.withColumn("n", F.row_number().over(Window.partitionBy("topic_id", "cu").orderBy("seq"))).where("n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy("seq"))).where(F.col("place") <= most).select("topic_id", "seq", "title", "url", "place")


def is_context_link(page_url: Column, url: Column, link_text: Column, topic_text: Column) -> Column:
    """Whether a link (absolute ``url``) of a source page gives context to a topic.

    No navigation and no social host; on the page's own host only links close to the topic;
    elsewhere links that share a word with it or lead to a product.
    """
    bare_host = lambda u: F.replace(U.host(u), F.lit("www."), F.lit(""))
    here, there, path = bare_host(page_url), bare_host(url), F.lower(U.path(url))
    both = F.struct(T.topic_tokens(topic_text).alias("asked"), T.topic_tokens(F.concat_ws(" ", F.coalesce(link_text, F.lit("")), url)).alias("said"))
    elsewhere = lambda t: (F.size(F.array_intersect(t["asked"], t["said"])) > 0) | U.contains_any(path, PRODUCT_PATHS)
    fits = once(both, lambda t: F.when(here == there, T.overlap(t["asked"], t["said"]) >= SAME_HOST_LEAST).otherwise(elsewhere(t)))
    allowed = url.rlike("^https?://") & ~there.isin(SOCIAL_HOSTS) & ~U.contains_any(path, NAVIGATION_PATHS)
    return F.coalesce(allowed & fits, F.lit(False))


def context_links(links: DataFrame, limit: int = 20) -> DataFrame:
    """(topic_id, page_url, pos, title, url) of links (topic_id, topic_text, page_url, pos, href, title) that give context: each address once, the first ``limit`` of a page."""
    title = T.title_collapsed(F.col("title"))
    gives = lambda u: (u != "") & is_context_link(F.col("page_url"), u, title, F.col("topic_text"))
    # as a generator: a filter on the address would be planned with the address written out at each of its uses
    found = once(U.canonical_url(U.resolve(F.col("page_url"), F.trim("href")), fold_host=False), lambda u: F.when(gives(u), F.array(u)))
    kept = links.select("topic_id", "page_url", "pos", title.alias("title"), found.alias("__found")).select("topic_id", "page_url", "pos", "title", F.explode("__found").alias("url"))
    page = ["topic_id", "page_url"]
    one = kept.withColumn("__n", F.row_number().over(Window.partitionBy(*page, "url").orderBy("pos"))).where("__n = 1")
    place = F.row_number().over(Window.partitionBy(*page).orderBy("pos"))
    return one.withColumn("__n", place).where(F.col("__n") <= limit).select(*page, "pos", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "url")


def expanded(topics: DataFrame, own: DataFrame, signals: DataFrame, links: DataFrame | None = None, most: int = 5) -> DataFrame:
    """The sources (topic_id, place, title, url, date, role, excerpt) of topics (topic_id, text): their own, then related signals, then context links of the first two sources' pages.

    ``own``: topic_id, seq, title, url, date, fallback. ``signals``: seq, title, snippet, source, published_at,
    perhaps full_text. ``links``: page_url, pos, href, title. Each address once; beyond the own ones, at most ``most``.
    """
    primary = own.where(U.canonical_url(F.col("url"), fold_host=False) != "").select(F.col("topic_id").alias("t")).distinct()
    asked = topics.join(primary, F.col("topic_id") == F.col("t"), "left").select("topic_id", "text", F.col("t").isNotNull().alias("has_primary"))
    first = excerpts(own, signals).select("topic_id", F.lit(1).alias("phase"), "seq", "title", "url", "date", F.lit("fresh_primary").alias("role"), "excerpt")
    full = F.nullif(F.col("full_text"), F.lit("")) if "full_text" in signals.columns else F.lit(None).cast("string")
    told = signals.select(F.col("seq").alias("s"), F.col("title"), F.col("source").alias("url"), F.col("published_at").alias("date"), F.coalesce(full, "snippet").alias("excerpt"))
    scored = related(asked, signals).join(told.select("s", "url"), F.col("seq") == F.col("s")).drop("s")
    picks = diverse(scored, own.select("topic_id", U.host(F.col("url")).alias("domain")), None).select("topic_id", "seq", "place")
    second = picks.join(told, F.col("seq") == F.col("s")).select("topic_id", F.lit(2).alias("phase"), F.col("place").cast("long").alias("seq"), "title", "url", "date", F.lit("related_fresh_signal").alias("role"), "excerpt")
    order = Window.partitionBy("topic_id").orderBy("phase", "seq")
    sources = appended(first.unionByName(second)).withColumn("place", F.row_number().over(order))
    if links is not None:
        pages = sources.where("place <= 2").join(topics.select(F.col("topic_id").alias("t"), F.col("text").alias("topic_text")), F.col("topic_id") == F.col("t")).select("topic_id", "topic_text", F.col("url").alias("of"), "place")
        found = context_links(pages.join(links, U.canonical_url(F.col("page_url"), fold_host=False) == F.col("of")), 10)
        third = found.select("topic_id", F.lit(3).alias("phase"), F.col("pos").cast("long").alias("seq"), "title", "url", F.lit("unknown").alias("date"), F.lit("context_link").alias("role"), F.lit("").alias("excerpt"))
        sources = appended(sources.drop("place").unionByName(third)).withColumn("place", F.row_number().over(order))
    return sources.where((F.col("place") <= most) | (F.col("phase") == 1)).select("topic_id", "place", "title", "url", "date", "role", "excerpt")
