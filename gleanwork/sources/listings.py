"""Landed HTML to dated items: search results, listing pages, vendor pages; registry files to rows.

A search result is cut by patterns, to the next result. Listing and vendor pages are read as flat trees: a listed
item is what its heading's or card's parent holds, a vendor link is dated by the closest of the four elements around
it that says a date and isn't long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions import dates
from gleanwork.functions import text as T
from gleanwork.functions import url as U
from gleanwork.sources import tree

SHORTEST_TITLE = 8


def _bare(html: Column) -> Column:
    return T.title_collapsed(T.decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def _first_of(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first row of each source per group, then the first ``most`` per group."""
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "source").orderBy("pos"))).where("__n = 1")
    return one.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("__n") <= most).drop("__n")


def search_results(landed: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """query, pos, title, snippet, source, published from landed result pages (query, html); redirects unwrapped, the first ``most`` with title and address."""
    parts = F.filter(F.split("html", r"(?i)<div[^>]*class=[\"'][^\"']*\bresult__body\b"), lambda b, i: i > 0)
    each = landed.select("query", F.posexplode(parts).alias("pos", "b"))
    found = r"(?is)<a\b(?=[^>]*class=[\"'][^\"']*result__a\b)[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    rows = each.select(
        "query", "pos", _bare(F.regexp_extract("b", found, 2)).alias("title"),
        _bare(F.regexp_extract("b", r"(?is)class=[\"'][^\"']*result__snippet[^>]*>(.*?)</(?:a|div|span)>", 1)).alias("snippet"),
        U.unwrapped(F.regexp_extract("b", found, 1)).alias("source"), dates.parse_any_date(_bare(F.concat(F.lit("<div "), F.col("b"))), as_of).alias("published"),
    )
    return _first_of(rows.where("title <> '' AND source <> ''"), ["query"], most)


# Classes of card links and of their holders, and the longest text around a vendor's link that dates it.
CARD_LINKS, CARD_HOLDERS = ["title", "entry-title"], ["post-title", "headline"]
LONGEST_BLOCK, AROUND = 1200, 4
HEADINGS = ("h2", "h3", "h4")


def _without(block: Column, title: Column) -> Column:
    """A block's text without the first place where it says the title."""
    at = F.instr(block, title)
    rest = F.concat(F.substring(block, F.lit(1), at - 1), F.substring(block, at + F.char_length(title), F.char_length(block)))
    return F.when((at > 0) & (title != ""), rest).otherwise(block)


def _heading_links(t: Column, headings: tuple[str, ...]) -> Column:
    """(el, a) of headings that hold a link with an address."""
    found = F.filter(tree.every(t), lambda i: t["tag"][i].isin(*headings))
    pairs = F.transform(found, lambda i: F.struct(i.alias("el"), tree.first_inside(t, i, "a").alias("a")))
    return F.filter(pairs, lambda p: p["a"].isNotNull() & (F.coalesce(t["href"][p["a"]], F.lit("")) != ""))


def _card_links(t: Column) -> Column:
    """(el, a) of links that are cards' titles by their class or by that of an element around them."""
    holders = F.filter(tree.every(t), lambda i: tree.has_class(t, i, CARD_HOLDERS))
    inside = lambda i: F.exists(holders, lambda h: (h < i) & (t["last"][h] >= i))
    found = F.filter(tree.every(t), lambda i: (t["tag"][i] == "a") & (F.coalesce(t["href"][i], F.lit("")) != "") & (tree.has_class(t, i, CARD_LINKS) | inside(i)))
    return F.transform(found, lambda i: F.struct(i.alias("el"), i.alias("a")))


def listed_items(landed: DataFrame, as_of: Column, most: int = 50, page_dates: DataFrame | None = None, headings: tuple[str, ...] = HEADINGS, cards: bool = True, shortest: int = SHORTEST_TITLE) -> DataFrame:
    """feed, pos, title, snippet, source, published from listing pages (feed, page, html): ``headings`` that hold a link, then cards.

    The first ``most`` of a page, each address once. Items without a date get that of their own page from
    ``page_dates`` (url, at), where it is landed.
    """
    t = F.col("tree")
    parsed = landed.select("feed", "page", tree.page_tree(F.col("html")).alias("tree"))
    both = F.concat(_heading_links(t, headings), _card_links(t)) if cards else _heading_links(t, headings)
    told = F.transform(both, lambda p: F.struct(tree.text_of(t, p["a"]).alias("title"), t["href"][p["a"]].alias("href"), tree.text_of(t, t["parent"][p["el"]]).alias("block")))
    long_enough = F.filter(told, lambda x: F.char_length(x["title"]) >= shortest)
    each = parsed.select("feed", "page", F.posexplode(F.slice(long_enough, 1, most)).alias("pos", "x"))
    rows = each.select(
        "feed", "pos", F.col("x.title").alias("title"), F.substring(F.trim(_without(F.col("x.block"), F.col("x.title"))), 1, 350).alias("snippet"),
        U.resolve(F.col("page"), F.col("x.href")).alias("source"), dates.parse_any_date(F.col("x.block"), as_of).alias("published"),
    )
    kept = _first_of(rows.where(F.col("source").isNotNull()), ["feed"], most)
    if page_dates is None:
        return kept
    known = page_dates.groupBy(F.col("url").alias("__of")).agg(F.max("at").alias("__at"))
    return kept.join(known, (F.col("source") == F.col("__of")) & F.col("published").isNull(), "left").withColumn("published", F.coalesce("published", "__at")).drop("__of", "__at")


def vendor_items(landed: DataFrame, as_of: Column, most: int = 25) -> DataFrame:
    """feed, pos, title, snippet, source, published from vendors' pages (feed, page, html): links that may be news.

    Of the elements around a link, up to four, those of at most 1200 characters that hold its title count: the closest with a
    date dates it and gives the snippet; without a date the outermost gives the snippet.
    """
    t = F.col("tree")
    parsed = landed.select("feed", "page", tree.page_tree(F.col("html")).alias("tree"))
    anchors = F.filter(tree.every(t), lambda i: (t["tag"][i] == "a") & t["href"][i].isNotNull())
    bounded = lambda i: F.left(tree.text_of(t, i), F.lit(LONGEST_BLOCK + 1))
    told = F.transform(anchors, lambda i: F.struct(tree.text_of(t, i).alias("title"), t["href"][i].alias("href"), F.transform(tree.ancestors(t, i, AROUND), bounded).alias("blocks")))
    each = parsed.select("feed", "page", F.posexplode(told).alias("pos", "x")).select("feed", "page", "pos", "x.title", "x.href", "x.blocks")
    each = each.where(U.is_link_candidate(F.col("page"), F.col("href"), F.col("title")))
    fitting = F.filter("blocks", lambda b: (F.char_length(b) <= LONGEST_BLOCK) & F.contains(b, F.col("title")))
    dated = F.transform(fitting, lambda b: F.struct(b.alias("block"), dates.parse_any_date(b, as_of).alias("at")))
    chosen = F.coalesce(F.try_element_at(F.filter(dated, lambda d: d["at"].isNotNull()), F.lit(1)), F.try_element_at(dated, F.lit(-1)))
    rows = each.withColumn("d", chosen).select(
        "feed", "pos", "title", F.substring(T.title_collapsed(_without(F.coalesce("d.block", F.element_at("blocks", 1)), F.col("title"))), 1, 350).alias("snippet"),
        U.resolve(F.col("page"), F.col("href")).alias("source"), F.col("d.at").alias("published"),
    )
    return _first_of(rows, ["feed"], most)


ANCHOR = r"(?is)<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a\s*>"


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, title, hints (attributes title and type) of all links, whatever their attributes and inner tags."""
    each = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("pos", "a"))
    group = lambda i: F.regexp_extract("a", ANCHOR, i)
    attribute = lambda n: F.regexp_extract("a", rf"(?is)^<a\b[^>]*?\s{n}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    title = F.regexp_replace(group(4), "<[^>]+>", " ")
    return each.select("page_id", "url", "pos", F.trim(F.concat(group(1), group(2), group(3))).alias("href"), title.alias("title"), F.concat_ws(" ", attribute("title"), attribute("type")).alias("hints"))


def pdf_links(pages: DataFrame) -> DataFrame:
    """url, title, context, discovered_from: the PDFs that pages (page_id, url, html) link to, each once per page, legal papers left out."""
    found = links(pages).where(U.is_pdf_link(F.col("href"), F.concat_ws(" ", "title", "hints")))
    told = found.select("pos", F.col("url").alias("discovered_from"), U.resolve(F.col("url"), F.col("href")).alias("url"), T.title_collapsed(F.col("title")).alias("title"), F.col("hints").alias("context"))
    first = F.row_number().over(Window.partitionBy("discovered_from", "url").orderBy("pos"))
    return told.withColumn("__n", first).where("__n = 1").select("url", "title", "context", "discovered_from")


FIELDS = ["id", "name", "source_type", "url", "html_parser", "category", "trust_level", "query", "engine"]
QUERY_FIELDS = {"id", "query", "engine", "enabled"}
REGISTRY = "file string, error string, " + ", ".join(f"{f} string" for f in FIELDS) + ", priority int, enabled boolean"


def registry_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all YAML files below a folder (a mapping or a list each); a file that can't be read gives one row with its error.

    ``registry_errors`` then says which rules each row breaks: keep rows without errors, or stop if there are any.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    found = yaml.safe_load(text) or []
                    found = found if isinstance(found, list) else [found]
                    error = None if all(isinstance(r, dict) for r in found) else "not a list of mappings"
                except yaml.YAMLError:
                    found, error = [], "not YAML"
                if error:
                    out.append({"file": file, "error": error})
                    continue
                for r in found:
                    told = {f: None if r.get(f) is None else str(r[f]) for f in FIELDS}
                    is_query = "query" in r and "source_type" not in r
                    unknown = sorted(set(r) - (QUERY_FIELDS if is_query else {*FIELDS, "priority", "enabled", "tags", "language", "notes"} - {"query", "engine"}))
                    priority = r.get("priority", 5)
                    out.append({"file": file, "error": f"unknown field {unknown[0]}" if unknown else None, **told, "priority": priority if isinstance(priority, int) else None, "enabled": bool(r.get("enabled", True))})
            frame = pd.DataFrame(out, columns=["file", "error", *FIELDS, "priority", "enabled"])
            yield frame.astype({f: object for f in ["file", "error", *FIELDS]} | {"priority": "Int32", "enabled": "boolean"})

    return files.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(rows, REGISTRY)
