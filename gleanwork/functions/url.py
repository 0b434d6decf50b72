"""URL expressions: canonical forms, hosts, path tests. All are null-safe: a null or empty URL gives ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_NETLOC = _SCHEME + r"(?://([^/?#]*))?"


def host(url: Column) -> Column:
    """The network location as written; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.trim(url), _NETLOC, 2), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(url), _NETLOC + r"([^?#]*)", 3), F.lit(""))


def _quote(value: Column) -> Column:
    """Decode and encode again; what can't be decoded is encoded as it is."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(value), value)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def kept_query(url: Column) -> Column:
    """The query without blank values and utm_ parameters of any case."""
    pairs = F.split(F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1), "&")
    named = F.filter(pairs, lambda p: p.rlike("^[^=]*=.") & ~F.lower(p).startswith("utm_"))
    return F.array_join(F.transform(named, lambda p: F.concat(_quote(F.substring_index(p, "=", 1)), F.lit("="), _quote(F.regexp_extract(p, "=(.*)$", 1)))), "&")


def canonical_url(url: Column, fold_host: bool = True) -> Column:
    """Without tracking parameters, fragment, path parameters and trailing slashes.

    ``fold_host``: lower-case scheme and host, drop every ``www.`` and default to https;
    otherwise both stay as written.
    """
    scheme, netloc = F.regexp_extract(F.trim(url), _SCHEME, 1), host(url)
    if fold_host:
        scheme = F.coalesce(F.nullif(F.lower(scheme), F.lit("")), F.lit("https"))
        netloc = F.replace(F.lower(netloc), F.lit("www."), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(path(url), r";[^/]*$", ""), r"/+$", "")
    query = kept_query(url)
    whole = F.concat(scheme, F.when(scheme != "", ":").otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""), bare, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "").otherwise(whole)


# Path fragments of news pages, common feed paths, link rules.
NEWS_PATHS = ["/news", "/press", "/press-release", "/blog", "/media", "/newsroom", "/insights", "/announcements", "/articles"]
FEED_PATHS = ["/feed/", "/feed", "/rss/", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/news/feed/", "/press/feed/", "/blog/feed/", "/index.xml"]
GENERIC_LINK_TITLES = [
    "contact", "contact us", "news", "news release", "announcement", "announcements", "read more", "read more »", "more", "learn more", "site map", "sitemap",
    "privacy policy", "terms", "skip to content", "personal information protection statement", "home", "events", "products", "japanese", "customer support",
    "support", "history", "full line solutions",
]
LINK_PATH_HINTS = [
    "news", "press", "release", "article", "blog", "media", "event", "solution", "smt", "aoi", "spi", "axi", "x-ray", "xray", "datasheet", "brochure", "spec",
    "specification", "catalog", "manual", "pdf", "download",
]
LINK_SKIP_PATHS = ["/support", "/privacy", "/policy", "/sitemap", "/contact", "/concept/history", "/category-"]
LEGAL_PDFS = [
    "privacy", "terms", "cookie", "legal", "sitemap", "tax", "w9", "iso9001", "certificate", "audit", "compliance-form", "supplier-code", "modern-slavery", "rohs-certificate",
]
PRODUCT_NEWS = r"(?i)\b(new|launch|introduc|release|update|series|platform)\b"
LINK_NEWS = r"(?i)\b(new|launch|introduc|release|unveil|showcase|exhibit|award|appoint|expand)\b"


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a substring."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)


def is_news_like(url: Column, extra: tuple[str, ...] = ()) -> Column:
    return contains_any(F.lower(path(url)), [*NEWS_PATHS, *extra])


def feed_candidates(url: Column) -> Column:
    """The common feed addresses of a site."""
    root = F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.transform(F.array(*[F.lit(p) for p in FEED_PATHS]), lambda p: F.concat(root, p))


def resolve(base: Column, href: Column) -> Column:
    """An absolute address for a link: absolute, scheme-relative, root-relative and sibling forms."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)[^/?#]*", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_extract(base, "^([^#?]*)", 1), href))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), href))
    )


def is_link_candidate(page_url: Column, href: Column, title: Column) -> Column:
    """Whether a link on a listing page leads to an item: nine rejections, then a path hint or a verb of news."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    low = F.lower(clean)
    absolute = resolve(page_url, href)
    here, there = F.replace(host(page_url), F.lit("www."), F.lit("")), F.replace(host(absolute), F.lit("www."), F.lit(""))
    p = F.lower(path(absolute))
    rejected = (
        (F.char_length(clean) < 8)
        | low.isin(GENERIC_LINK_TITLES)
        | low.rlike("^(read more|skip|contact)")
        | href.rlike("^(mailto|tel|javascript):")
        | ((here != "") & (there != "") & ~F.contains(there, here) & ~F.contains(here, there))
        | (absolute.contains("#") & (path(absolute) == ""))
        | (F.rtrim(absolute, F.lit("/")) == F.rtrim(page_url, F.lit("/")))
        | contains_any(p, LINK_SKIP_PATHS)
        | (p.contains("/product/") & ~clean.rlike(PRODUCT_NEWS))
    )
    return ~rejected & (contains_any(p, LINK_PATH_HINTS) | clean.rlike(LINK_NEWS))


def unwrapped(href: Column) -> Column:
    """The target of a search engine's redirect link (parameter uddg), or the link itself."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1)
    return F.when(target != "", F.coalesce(F.try_url_decode(target), target)).otherwise(F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href))


def age_bucket(days: Column) -> Column:
    """A search engine's time filter for a look-back of so many days."""
    return F.when(days <= 1, "d").when(days <= 7, "w").when(days <= 31, "m").when(days <= 366, "y").otherwise("")


def is_pdf_link(href: Column, text: Column) -> Column:
    """Whether a link leads to a PDF, by its address or its words, that is no legal paper."""
    low, said = F.lower(href), F.lower(F.coalesce(text, F.lit("")))
    elsewhere = low.rlike("^(mailto:|tel:|javascript:|#)") | (low == "")
    return (low.rlike(r"\.pdf($|[?#])") | said.contains("pdf")) & ~elsewhere & ~contains_any(low, LEGAL_PDFS) & ~contains_any(said, LEGAL_PDFS)
