"""Date expressions. Every relative form takes an explicit ``as_of`` timestamp; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their numbers.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8,
    "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
MONTH_DAY = rf"\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[,]?\s+(20\d{{2}})\b"
DAY_MONTH = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_NAMES})\.?[,]?\s+(20\d{{2}})\b"
ISO_DAY = r"\b(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T\s][0-9:.+-Z]+)?\b"


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(names, name)


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none."""
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.when(year.try_cast("int").isNotNull() & month.try_cast("int").isNotNull() & day.try_cast("int").isNotNull(), text.try_cast("date"))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def parse_any_date(text: Column, as_of: Column) -> Column:
    """The timestamp a snippet names: today, yesterday, N units ago, ISO, Month D YYYY, D Month YYYY, in that order.

    Each pattern's first hit counts; a day the calendar lacks falls through to the next pattern.
    """
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.lower(s)
    ago = r"\b(\d{1,2})\s+(minute|hour|day|week|month)s?\s+ago\b"
    unit, n = _group(low, ago, 2), _group(low, ago, 1).try_cast("int")
    seconds = n * F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 7 * 86400).when(unit == "month", 30 * 86400)
    back = lambda secs: as_of - F.make_dt_interval(secs=secs)
    iso = _day(_group(s, ISO_DAY, 1), _group(s, ISO_DAY, 2), _group(s, ISO_DAY, 3))
    month_day = _day(_group(low, MONTH_DAY, 3), _month(_group(low, MONTH_DAY, 1)), _group(low, MONTH_DAY, 2))
    day_month = _day(_group(low, DAY_MONTH, 3), _month(_group(low, DAY_MONTH, 2)), _group(low, DAY_MONTH, 1))
    return (
        F.when(low.rlike(r"\btoday\b"), as_of)
        .when(low.rlike(r"\byesterday\b"), back(F.lit(86400)))
        .when(unit != "", back(seconds))
        .otherwise(F.coalesce(*[d.cast("timestamp") for d in (iso, month_day, day_month)], s.try_cast("timestamp")))
    )


def parse_feed_date(text: Column, as_of: Column) -> Column:
    """RFC 822 as feeds write it, else any date."""
    bare = F.regexp_replace(F.trim(text), r"^\w{3},\s*", "")
    bare = F.regexp_replace(bare, r" (GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), parse_any_date(text, as_of))


def parse_pdf_date(text: Column, fallback: Column) -> Column:
    """D:YYYYMMDD, ISO or Month D YYYY; the fallback text is read only where the date text is empty, and for month names only."""
    s, pdf = F.trim(F.coalesce(text, F.lit(""))), r"D:?(\d{4})(\d{2})(\d{2})"
    iso = r"\b(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})\b"
    named = F.lower(F.when(s != "", s).otherwise(F.coalesce(fallback, F.lit(""))))
    return F.coalesce(
        _day(*[F.nullif(_group(s, pdf, i), F.lit("")) for i in (1, 2, 3)]),
        _day(*[F.nullif(_group(s, iso, i), F.lit("")) for i in (1, 2, 3)]),
        _day(_group(named, MONTH_DAY, 3), _month(_group(named, MONTH_DAY, 1)), _group(named, MONTH_DAY, 2)),
    )


def parse_sitemap_date(text: Column) -> Column:
    """W3C datetime or date; the zone is dropped, not converted."""
    s = F.trim(text)
    full = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:Z|[+-]\d{2}:?\d{2})$", 1)
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})$", 1)
    return F.nullif(F.concat(full, day), F.lit("")).try_cast("timestamp_ntz")


def iso_or_unknown(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("unknown"))


def within_lookback(at: Column, days: int, as_of: Column) -> Column:
    """Not null, at most ``days`` old and at most a day ahead, both ends included."""
    return F.coalesce(at.between(as_of - F.make_dt_interval(F.lit(days)), as_of + F.make_dt_interval(F.lit(1))), F.lit(False))


def is_fresh(at: Column, days: int, as_of: Column, strict: bool) -> Column:
    """Undated items pass unless ``strict``; stale ones never do."""
    fresh = within_lookback(at, days, as_of)
    return fresh if strict else fresh | at.isNull()


def in_zone(at: Column, zone: str) -> Column:
    """A time without a zone (timestamp_ntz) as the moment it names in this zone; moments stay."""
    return F.to_utc_timestamp(at.cast("timestamp_ntz").cast("timestamp"), zone)
