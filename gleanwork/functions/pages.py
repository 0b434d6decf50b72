"""Expressions over landed pages and stored JSON: dates with their provenance, URLs inside JSON, front matter, prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanwork.functions import dates
from gleanwork.functions import text as T

# Where pages state their date, in order.
META_KEYS = [
    "article:published_time", "article:modified_time", "og:published_time", "datePublished", "dateModified", "publishdate", "pubdate", "timestamp",
    "DC.date", "dc.date", "sailthru.date",
]
JSON_LD_KEYS = ["datePublished", "dateModified", "uploadDate", "dateCreated"]
ROLE_LABELS = {"fresh_primary": "primary source", "related_fresh_signal": "independent confirmation", "context_link": "maker's context"}


#: Elements without article text, and classes of the element that holds it.
UNREAD = re.compile(r"<!--.*?-->|<(script|style)(?=[\s/>])[^>]*>.*?</\1\s*>", re.S | re.I)
BOILERPLATE = re.compile(r"<(/?)(nav|header|footer|aside|form)(?=[\s/>])[^>]*>", re.I)
ARTICLE = re.compile(r"<(article)(?=[\s/>])[^>]*>", re.I)
ENTRY = re.compile(r"<([a-z][a-z0-9]*)\s(?:[^>]*?\s)?class\s*=\s*(?:\"[^\">]*?|'[^'>]*?|[^\s\"'>]*?)(?:article|post|entry)[-_]?(?:body|content)[^>]*>", re.I)


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def json_urls(raw: Column) -> Column:
    """All strings under the keys url, source_url and link (any case) at any depth, in order; empty if it isn't JSON.

    Quotes inside JSON strings are escaped, so a quoted key before a colon is always a key.
    """
    found = F.regexp_extract_all(_known(raw), F.lit(r'"(?i:url|source_url|link)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.transform(found, lambda u: F.from_json(F.concat(F.lit('["'), u, F.lit('"]')), "array<string>")[0])
    return F.when(F.try_parse_json(raw).isNotNull(), F.filter(plain, lambda u: u != "")).otherwise(F.array().cast("array<string>"))


def stated_date(payload: str) -> str | None:
    """The first date of a JSON-LD payload: objects in document order, each one's date keys in list order; None without one or if it isn't JSON."""
    try:
        waiting = [json.loads(payload)]
    except (ValueError, RecursionError):
        return None
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            for key in JSON_LD_KEYS:
                if value.get(key):
                    return str(value[key])
        children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        waiting.extend(reversed([c for c in children if isinstance(c, dict | list)]))
    return None


@F.pandas_udf(ArrayType(StringType()))
def json_ld_dates(scripts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each JSON-LD payload of a page the date it states; payloads without one or that aren't JSON are left out."""

    for batch in scripts:
        yield batch.map(lambda payloads: [d for d in map(stated_date, payloads if payloads is not None else []) if d])


def _meta(html: Column, key: str) -> Column:
    named = rf"(?:property|name)=[\"']{key.replace('.', '[.]')}[\"']"
    after = T.first_match(html, rf"(?s)<meta\s[^>]*?{named}[^>]*?\bcontent=[\"']([^\"']*)[\"']")
    return F.coalesce(after, T.first_match(html, rf"(?s)<meta\s[^>]*?\bcontent=[\"']([^\"']*)[\"'][^>]*?{named}"))


def page_date(html: Column, as_of: Column) -> Column:
    """struct(at, source): the first date that parses of meta tags, JSON-LD, time elements and the first 5000 visible characters; null if none."""
    ld = json_ld_dates(F.regexp_extract_all(_known(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)))
    visible = F.regexp_replace(_known(html), r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    shown = F.substring(T.title_collapsed(F.regexp_replace(visible, "<[^>]+>", " ")), 1, 5000)
    told = lambda raw, source: F.struct(raw.alias("raw"), F.lit(source).alias("source"))
    stated = [told(_meta(html, k), f"meta:{k}") for k in META_KEYS]
    rest = [told(T.first_match(html, r"(?is)<time\b[^>]*\bdatetime=[\"']([^\"']*)[\"']"), "time:datetime"), told(shown, "page_text")]
    every = F.concat(F.array(*stated), F.transform(ld, lambda d: told(d, "jsonld")), F.array(*rest))
    dated = F.transform(every, lambda c: F.struct(dates.parse_any_date(c["raw"], as_of).alias("at"), c["source"].alias("source")))
    return F.try_element_at(F.filter(dated, lambda c: c["at"].isNotNull()), F.lit(1))


def front_matter(tags: Column, section: Column, source_url: Column, seo: Column, final_slug: Column) -> Column:
    """JSON of a draft's metadata. ``seo``: struct(slug, meta_description, jsonld, internal_links) or null; its
    JSON-LD gets the final slug where that differs from the provisional one."""
    differs = (_known(seo["jsonld"]) != "") & (_known(seo["slug"]) != "") & (seo["slug"] != final_slug)
    fixed = F.when(differs, F.replace(seo["jsonld"], F.concat(F.lit("/"), seo["slug"]), F.concat(F.lit("/"), final_slug))).otherwise(_known(seo["jsonld"]))
    kept = F.when(seo.isNotNull(), F.struct(_known(seo["meta_description"]).alias("meta_description"), fixed.alias("jsonld"), seo["internal_links"].alias("internal_links")))
    return F.to_json(F.struct(F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), section.alias("section_routing"), source_url.alias("source_url"), kept.alias("seo")))


def writer_prompt(topic: Column, angle: Column, facts: Column, sources: Column) -> Column:
    """A brief as a prompt. ``sources``: array of struct(title, url, date, role, excerpt); those with an excerpt are
    shown with 550 characters of it, the others as links; two or more with one ask for a synthesis."""
    said = lambda s: F.trim(_known(s["excerpt"])) != ""
    full, bare = F.filter(sources, said), F.filter(sources, lambda s: ~said(s))
    role = lambda s: F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])[s["role"]], s["role"], F.lit("source"))
    block = F.transform(full, lambda s, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(": "), _known(s["title"]), F.lit(" ("), role(s), F.lit(", "), F.coalesce(s["date"], F.lit("unknown")), F.lit(")\n"), _known(s["url"]), F.lit("\n"), F.substring(F.trim(s["excerpt"]), 1, 550)))
    link = F.transform(bare, lambda s: F.concat(F.lit("- "), _known(s["title"]), F.lit(" "), _known(s["url"])))
    parts = [
        F.concat(F.lit("Topic: "), _known(topic)),
        F.when(_known(angle) != "", F.concat(F.lit("Angle: "), angle)),
        F.when(F.size(facts) > 0, F.concat(F.lit("Facts:\n- "), F.array_join(facts, "\n- "))),
        F.when(F.size(full) > 0, F.array_join(block, "\n\n")),
        F.when(F.size(full) > 1, F.lit("Several sources: combine them and state where they differ.")),
        F.when(F.size(bare) > 0, F.concat(F.lit("Links without text:\n"), F.array_join(link, "\n"))),
    ]
    return F.concat_ws("\n\n", *parts)


def container_of(page: str | None) -> str:
    """What the page's article holds, else an element classed as article, post or entry body, else the whole page; boilerplate elements go first."""
    page = UNREAD.sub(" ", page or "")
    opened: dict[str, list[int]] = {}
    cuts = []
    for m in BOILERPLATE.finditer(page):
        if not m.group(1):
            opened.setdefault(m.group(2).lower(), []).append(m.start())
        elif opened.get(m.group(2).lower()):
            cuts.append((opened[m.group(2).lower()].pop(), m.end()))
    parts, at = [], 0
    for lo, hi in sorted(cuts):
        if lo >= at:
            parts.append(page[at:lo])
        at = max(at, hi)
    page = " ".join([*parts, page[at:]])
    found = ARTICLE.search(page) or ENTRY.search(page)
    if not found:
        return page
    depth = 1
    for m in re.compile(rf"<(/?){found.group(1)}(?=[\s/>])[^>]*>", re.I).finditer(page, found.end()):
        depth += -1 if m.group(1) else 1
        if not depth:
            return page[found.end() : m.start()]
    return page[found.end() :]


def article_html(html: Column) -> Column:
    """``container_of`` as an expression."""

    @F.pandas_udf("string")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(container_of, na_action=None)

    return held(html)


def article_text(html: Column, limit: int = 1800) -> Column:
    """The text of the article's paragraphs, joined by spaces, up to ``limit`` characters."""
    ps = F.transform(F.regexp_extract_all(article_html(html), F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: T.title_collapsed(T.strip_tags(p)))
    return F.substring(F.array_join(F.filter(ps, lambda p: p != ""), " "), 1, limit)
