"""Text expressions: slugs, titles, tokens, overlap, tag stripping, descriptions, hashes."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.bind import once

# Stop words of duplicate titles and of topics, and the entities decoded without Python.
TITLE_STOPS = [
    "the", "and", "for", "with", "what", "how", "why", "new", "review", "launch", "launches", "series", "system", "systems", "smt", "pcb", "pcba", "inspection",
    "manufacturing", "electronics", "higher", "throughput",
]
TOPIC_STOPS = [
    "the", "and", "with", "for", "from", "into", "that", "this", "what", "when", "where", "which", "while", "series", "system", "systems", "launch", "launches",
    "new", "high", "throughput", "inspection", "electronics", "manufacturing", "supports", "upgrade", "technology", "solutions", "group", "inc", "ltd", "gmbh",
]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def slugify(text: Column, limit: int = 200) -> Column:
    """Lower case, letters a-z, digits and single hyphens; cut last, so a long slug may end in a hyphen."""
    kept = F.regexp_replace(F.lower(_known(text)), r"[^a-z0-9\s-]", "")
    return F.substring(F.trim(F.regexp_replace(kept, r"[\s-]+", "-"), F.lit("-")), 1, limit)


def registry_slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(_known(text)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("source"))


def title_spaced(text: Column) -> Column:
    """For comparing with stored titles: other characters become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_known(text)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_deleted(text: Column) -> Column:
    """For comparing within a scan: other characters vanish, so x-ray is one word."""
    return F.trim(F.regexp_replace(F.lower(_known(text)), "[^a-z0-9 ]", ""), F.lit(" "))


def title_collapsed(text: Column) -> Column:
    """White space collapsed only."""
    return F.trim(F.regexp_replace(_known(text), r"\s+", " "))


def title_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(title_spaced(text), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in TITLE_STOPS]))


def scan_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title_deleted(text), " +"), lambda w: w != ""))


def topic_tokens(text: Column) -> Column:
    """Hyphens stay inside words; stop words are tested before hyphens at the ends go."""
    words = F.regexp_extract_all(F.lower(_known(text)), F.lit(r"[a-zA-Z0-9][a-zA-Z0-9\-]{2,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(TOPIC_STOPS))
    return F.array_distinct(F.transform(kept, lambda w: F.trim(w, F.lit("-"))))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def strip_tags(text: Column, limit: int | None = None) -> Column:
    bare = F.regexp_replace(_known(text), "<[^>]+>", "")
    return bare if limit is None else F.substring(bare, 1, limit)


REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
AMPERSANDS = ["&amp;", "&#38;", "&#x26;", "&#X26;"]


def _character(reference: Column) -> Column:
    """The character that a reference stands for; the reference itself where it stands for none."""
    named = F.create_map(*[F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))])
    bare = F.substring(reference, F.lit(2), F.char_length(reference) - 2)
    hexed = F.when(bare.rlike("^#[xX]"), F.substring(bare, F.lit(3), F.char_length(bare))).otherwise(F.hex(F.substring(bare, F.lit(2), F.char_length(bare)).try_cast("int")))
    point = F.conv(hexed, 16, 10).try_cast("int")
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(bare.startswith("#"), numbered).otherwise(F.try_element_at(named, bare)), reference)


def decode_entities(text: Column) -> Column:
    """Numeric and named character references (those of HTML 4), each different one once; & last, so nothing is decoded twice."""
    for name, char in ENTITIES.items():
        if char != "&":
            text = F.replace(text, F.lit(name), F.lit(char))

    def rare(t: Column) -> Column:
        found = F.array_except(F.array_distinct(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))), F.array(*[F.lit(a) for a in AMPERSANDS]))
        return F.aggregate(found, t, lambda done, r: F.replace(done, r, _character(r)))

    text = once(text, lambda t: F.when(t.rlike(REFERENCE), rare(t)).otherwise(t))
    for name in AMPERSANDS:
        text = F.replace(text, F.lit(name), F.lit("&"))
    return text


def upload_name(text: Column) -> Column:
    """A file name of letters, digits, dots, hyphens and underscores only."""
    return F.regexp_replace(_known(text), r"[^a-zA-Z0-9_.-]", "")


def request_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def html_to_plain(html: Column) -> Column:
    """Line breaks for br, empty lines for closed blocks, no tags, decoded, lines squeezed, one line feed at the end."""
    t = F.regexp_replace(_known(html), r"(?i)<\s*br\s*/?\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</\s*(p|div|h[1-6]|li|ul|ol|blockquote|section|article)\s*>", "\n\n")
    t = F.replace(decode_entities(strip_tags(t)), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return F.concat(F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n")), F.lit("\n"))


def first_match(html: Column, pattern: str) -> Column:
    """The first group, or null."""
    return F.nullif(F.trim(F.regexp_extract(_known(html), pattern, 1)), F.lit(""))


def page_title(html: Column) -> Column:
    """h1, else og:title or meta title, else the title element; tags stripped, white space collapsed."""
    meta = first_match(html, r"(?is)<meta\s+(?:property|name)=[\"'](?:og:title|title)[\"']\s+content=[\"']([^\"']*)[\"']")
    found = F.coalesce(first_match(html, r"(?is)<h1[^>]*>(.*?)</h1>"), meta, first_match(html, r"(?is)<title[^>]*>(.*?)</title>"))
    return title_collapsed(decode_entities(strip_tags(found)))


def meta_description(body: Column, summary: Column) -> Column:
    """The summary, or else the bare body: up to 160 characters as they are, else cut at a word's end within 157."""
    source = F.when(_known(summary) != "", F.trim(_known(summary))).otherwise(F.trim(strip_tags(body)))
    cut = F.substring(source, 1, 157)
    space = 157 - F.instr(F.reverse(cut), " ")  # from 0; 157 if there is none
    cut = F.when((space > 100) & (space < 157), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.char_length(source) <= 160, source).otherwise(F.concat(F.rtrim(cut, F.lit(",.;: ")), F.lit("…")))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(title_collapsed(text), 256)


def json_ld(title: Column, description: Column, slug: Column, category: Column, site: str, publisher: str, as_of: Column) -> Column:
    """An Article object for search engines, dated as_of."""
    lit, day = F.lit, F.date_format(as_of, "yyyy-MM-dd")
    org = lambda name: F.struct(lit("Organization").alias("@type"), lit(name).alias("name"))
    logo = F.struct(lit("ImageObject").alias("@type"), lit(f"{site}/logo.png").alias("url"))
    return F.to_json(
        F.struct(
            lit("https://schema.org").alias("@context"), lit("Article").alias("@type"), title.alias("headline"), description.alias("description"),
            org(f"{publisher} Editorial").alias("author"),
            F.struct(lit("Organization").alias("@type"), lit(publisher).alias("name"), logo.alias("logo")).alias("publisher"),
            F.struct(lit("WebPage").alias("@type"), F.concat(lit(f"{site}/news/"), slug).alias("@id")).alias("mainEntityOfPage"),
            day.alias("datePublished"), day.alias("dateModified"),
            F.struct(lit("Thing").alias("@type"), category.alias("name")).alias("about"),
        )
    )


def lenient_json(raw: Column) -> Column:
    """The JSON value inside a reply: without code fences, from the first bracket to its last partner; null if there is none."""
    bare = F.regexp_replace(F.trim(_known(raw)), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")))
