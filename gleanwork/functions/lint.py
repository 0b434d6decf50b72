"""Text-quality checks as expressions: each gives an array of issues, a report sums them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.bind import once
from gleanwork.functions.url import contains_any

# Phrases not to use, words that make no title specific, word ranges by format.
BANNED_PHRASES = [
    "in today's fast-paced", "in the ever-evolving landscape", "it is worth noting", "it should be mentioned", "as we can see", "at the end of the day",
    "when it comes to", "in conclusion", "dive into", "delve into", "unlock the potential", "unlock the power", "seamlessly", "seamless integration",
    "robust solution", "cutting-edge", "state-of-the-art solution", "game-changer", "game-changing", "revolutionize", "revolutionary", "paradigm shift",
    "next-generation solution", "industry-leading", "unparalleled", "the future of", "as technology continues to advance", "moreover,", "furthermore,",
    "additionally,", "in summary,", "to sum up",
]
GENERIC_TITLE_WORDS = [
    "new", "improvements", "improvement", "manufacturing", "quality", "system", "systems", "solution", "solutions", "technology", "technologies", "process",
    "processes", "production", "update", "updates", "guide", "overview", "review", "analysis", "report", "industry", "equipment", "market", "trends", "trend",
    "insights", "insight", "news", "future", "advanced", "modern", "latest", "best", "top", "key", "major", "global", "smart", "digital", "innovation",
    "innovations", "development", "developments", "growth", "strategy", "in", "for", "with", "and", "the", "of", "to", "on", "at",
]
WORD_RANGES = {"news": (350, 900), "insight": (600, 2200), "review": (700, 2500), "vendor": (500, 2000), "magazine": (700, 3000), "article": (600, 2500)}
OTHER_RANGE = (350, 1250)
WITH_HEADINGS = ["insight", "review", "vendor"]
RULE_OF_THREE = r"(?iU)\b(\w+(?:\s\w+){0,2}),\s(\w+(?:\s\w+){0,2}),?\sand\s(\w+(?:\s\w+){0,2})\b"
#: What every match of it holds; begins with a comma, so it is found fast where there is none.
THREES_NEED = r"(?iU),\s\w+(?:\s\w+){0,2},?\sand\s\w"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZА-Я0-9])"
HEADING = r"^##\s+\S"
NUMBER = r"(?U)\b\d[\d,.]*\s?%?\b"
FLAT_SENTENCES, FLAT_PARAGRAPHS = 0.28, 0.25
COSTS = {"error": 15, "warning": 6}

ISSUES = "array<struct<code:string,detail:string,severity:string>>"


def _issue(code: str, severity: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"), F.lit(severity).alias("severity"))


def _one(found: Column, issue: Column) -> Column:
    return F.when(found, F.array(issue)).otherwise(F.array().cast(ISSUES))


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(_known(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(_known(text), F.lit(r"\S+"))


def headings(text: Column) -> Column:
    return F.filter(F.split(_known(text), "\n"), lambda s: F.trim(s).rlike(HEADING))


def sentences(text: Column) -> Column:
    """Heading lines left out; split after . ! ? and white space before a capital or digit."""
    lines = F.filter(F.split(_known(text), "\n"), lambda s: ~F.trim(s).rlike(HEADING))
    return F.filter(F.transform(F.split(F.array_join(lines, " "), SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(_known(text), "\n\n"), lambda p: (F.trim(p, F.lit(" \n\t")) != "") & ~F.trim(p, F.lit(" \n\t")).rlike(HEADING))


def rhythm(parts: Column) -> Column:
    """Population standard deviation of the parts' word counts over their mean; null without words."""
    zero = F.lit(0).cast("long")

    def spread(lengths: Column) -> Column:
        n, total = F.size(lengths), F.aggregate(lengths, zero, lambda a, x: a + x)
        squares = F.aggregate(lengths, zero, lambda a, x: a + x * x)
        return F.sqrt((n * squares - total * total).cast("double")) / F.nullif(total, zero)

    return once(F.transform(parts, lambda p: word_count(p).cast("long")), spread)


def banned_phrases(text: Column, phrases: list[str] = BANNED_PHRASES) -> Column:
    """One error per phrase that occurs, in list order."""
    each = F.array(*[F.lit(p) for p in phrases])
    hits = once(F.lower(_known(text)), lambda low: F.filter(each, lambda p: F.contains(low, p)))
    return F.transform(hits, lambda p: _issue("banned_phrase", "error", p))


def threes(text: Column) -> Column:
    count = lambda t: F.when(t.rlike(THREES_NEED), F.regexp_count(t, F.lit(RULE_OF_THREE))).otherwise(0)
    return once(_known(text), count)


def rule_of_three(text: Column) -> Column:
    return _one(threes(text) >= 2, _issue("rule_of_three", "warning"))


def _flat(parts: Column, least: int, below: float, code: str) -> Column:
    return once(parts, lambda p: _one((F.size(p) >= least) & (rhythm(p) < below), _issue(code, "warning")))


def sentence_rhythm(text: Column, parts: Column | None = None) -> Column:
    """``parts``: the text's sentences, where they are at hand."""
    return _flat(sentences(text) if parts is None else parts, 6, FLAT_SENTENCES, "flat_sentence_rhythm")


def paragraph_rhythm(text: Column) -> Column:
    return _flat(paragraphs(text), 4, FLAT_PARAGRAPHS, "flat_paragraph_rhythm")


def missing_headings(text: Column, kind: Column, found: Column | None = None) -> Column:
    """``found``: the text's headings, where they are at hand."""
    return _one(kind.isin(WITH_HEADINGS) & (F.size(headings(text) if found is None else found) == 0), _issue("missing_headings", "warning"))


def _bound(kind: Column, i: int) -> Column:
    out = F.lit(OTHER_RANGE[i])
    for name, pair in WORD_RANGES.items():
        out = F.when(kind == name, pair[i]).otherwise(out)
    return out


def word_range(text: Column, kind: Column, n: Column | None = None) -> Column:
    """``n``: the text's number of words, where it is at hand."""

    def judged(n: Column) -> Column:
        too_short, too_long = _issue("too_short", "warning", n), _issue("too_long", "warning", n)
        return F.when(n < _bound(kind, 0), F.array(too_short)).when(n > _bound(kind, 1), F.array(too_long)).otherwise(F.array().cast(ISSUES))

    return judged(n) if n is not None else once(word_count(text), judged)


def is_specific(title: Column) -> Column:
    """A digit, an acronym, or a capitalised word after the first that isn't a generic one."""

    def specific(t: Column) -> Column:
        proper = once(words(t), lambda w: F.exists(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda x: x.rlike(r"^\p{Lu}") & ~F.lower(F.trim(x, F.lit(".,:"))).isin(GENERIC_TITLE_WORDS)))
        return t.rlike(r"(?U)\d") | t.rlike(r"(?U)\b[A-Z]{2,}\b") | proper

    return once(_known(title), specific)


def title_specificity(title: Column) -> Column:
    return _one(~is_specific(title), _issue("generic_title", "warning"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_known(text), F.lit(NUMBER), F.lit(0)))


def fact_grounding(body: Column, facts: Column) -> Column:
    """An error if the facts hold numbers and the body none of them."""
    wanted = F.array_distinct(F.flatten(F.transform(F.coalesce(facts, F.array().cast("array<string>")), numbers)))
    return once(wanted, lambda w: _one((F.size(w) > 0) & ~F.arrays_overlap(w, numbers(body)), _issue("no_fact_grounding", "error")))


def lint_issues(title: Column, body: Column, kind: Column, facts: Column, parts: Column | None = None, found: Column | None = None, n: Column | None = None) -> Column:
    """All checks' issues in order; ``parts``, ``found`` and ``n``: the body's sentences, headings and number of words, where they are at hand."""
    return F.concat(
        banned_phrases(F.concat(_known(title), F.lit(" "), _known(body))), rule_of_three(body), sentence_rhythm(body, parts), paragraph_rhythm(body),
        missing_headings(body, kind, found), word_range(body, kind, n), title_specificity(title), fact_grounding(body, facts),
    )


def score(issues: Column) -> Column:
    """100 less 15 for each error and 6 for each warning, at least 0."""
    cost = F.aggregate(issues, F.lit(0), lambda a, x: a + F.when(x["severity"] == "error", COSTS["error"]).otherwise(COSTS["warning"]))
    return F.greatest(F.lit(0), F.lit(100) - cost)


def has_errors(issues: Column) -> Column:
    return F.exists(issues, lambda x: x["severity"] == "error")


def lint_report(title: Column, body: Column, kind: Column, facts: Column) -> Column:
    """score, has_errors, counts and issues; the body is split and counted once."""

    def report(issues: Column, parts: Column, found: Column, n: Column) -> Column:
        return F.struct(
            score(issues).alias("score"), has_errors(issues).alias("has_errors"), n.alias("word_count"),
            F.size(parts).alias("sentence_count"), F.size(found).alias("heading_count"), issues.alias("issues"),
        )

    def measured(m: Column) -> Column:
        parts, found, n = m["parts"], m["found"], m["n"]
        return once(lint_issues(title, body, kind, facts, parts, found, n), lambda issues: report(issues, parts, found, n))

    return once(F.struct(sentences(body).alias("parts"), headings(body).alias("found"), word_count(body).alias("n")), measured)


def quality_verdict(rated: Column, lint_score: Column, least: int = 75) -> Column:
    """'improve' where the rating is 0 or the lint score below ``least``, else 'pass'."""
    return F.when((rated == 0) | (lint_score < least), "improve").otherwise("pass")


def repaired(before: Column, after: Column, issues_before: Column, issues_after: Column) -> Column:
    """What stays of a draft and its one repair: the repair, unless it is missing or has errors that the draft had not."""
    usable = (F.coalesce(F.trim(after), F.lit("")) != "") & ~(has_errors(issues_after) & ~has_errors(issues_before))
    return F.when(F.coalesce(usable, F.lit(False)), after).otherwise(before)


def is_relevant(text: Column, terms: list[str]) -> Column:
    """Any term as a substring of the lower-cased text."""
    return once(F.lower(_known(text)), lambda low: contains_any(low, terms))
