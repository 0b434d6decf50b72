"""Small builders for the DuckDB SQL that mirrors the expressions of this package."""

from __future__ import annotations

from gleanwork.functions.text import ENTITIES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def wordy(c: str) -> str:
    """``c`` with _ for each letter, digit or mark beyond ASCII, so that \\w and \\b, which know ASCII only, find the same words."""
    return rf"regexp_replace(coalesce({c}, ''), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]|[^\x00-\x7F\P{{M}}]', '_', 'g')"


def spaced(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def deleted(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', '', 'g'))"


def collapsed(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def slug(c: str, n: int = 200) -> str:
    return rf"substr(trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-'), 1, {n})"


def title_tokens(c: str, stops) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all({spaced(c)}, '[a-z0-9][a-z0-9\-]{{2,}}')), lambda w: NOT list_contains({strings(stops)}, w))"


def topic_tokens(c: str, stops) -> str:
    found = rf"regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z0-9][a-zA-Z0-9\-]{{2,}}')"
    return f"list_distinct(list_transform(list_filter({found}, lambda w: NOT list_contains({strings(stops)}, w)), lambda w: trim(w, '-')))"


def scan_tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({deleted(c)}, ' '), lambda w: w <> ''))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END"


def host(c: str) -> str:
    return rf"regexp_extract({c}, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?', 2)"


def path(c: str) -> str:
    return rf"regexp_extract({c}, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', 3)"


def canonical(c: str, fold: bool = True) -> str:
    scheme, netloc = rf"regexp_extract({c}, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?', 1)", host(c)
    if fold:
        scheme, netloc = f"coalesce(nullif(lower({scheme}), ''), 'https')", f"replace(lower({netloc}), 'www.', '')"
    bare = f"regexp_replace(regexp_replace({path(c)}, ';[^/]*$', ''), '/+$', '')"
    query = rf"array_to_string(list_filter(string_split(regexp_extract({c}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND NOT starts_with(lower(p), 'utm_')), '&')"
    return f"({scheme} || CASE WHEN {scheme} <> '' THEN ':' ELSE '' END || CASE WHEN {netloc} <> '' THEN '//' || {netloc} ELSE '' END || {bare} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"


def strip_tags(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g')"


def decoded(c: str) -> str:
    for name, char in ENTITIES.items():
        c = f"replace({c}, {quoted(name)}, {quoted(char)})"
    return c


def any_of(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(t)})" for t in terms) + ")" if terms else "false"


def any_match(c: str, patterns) -> str:
    return f"regexp_matches({c}, {quoted('|'.join(f'(?:{p})' for p in patterns))})"


def weighted(c: str, patterns) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({c}, {quoted(p)}) THEN {w} ELSE 0 END" for p, w in patterns) + ")"


SIGNALS = rf"""signals AS (
  SELECT page_id AS seq, {collapsed("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         substr({collapsed(strip_tags("regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)"))}, 1, 350) AS snippet, url AS source, {host("url")} AS feed
  FROM pages
)"""
