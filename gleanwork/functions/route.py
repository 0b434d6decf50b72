"""The section router: weighted patterns summed to scores, then a decision list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions import terms
from gleanwork.functions.bind import once

# Pattern tables (each pattern counts once), term lists, aliases and paths.
REVIEW = [
    (r"\breview\b", 30), (r"\bbuyer\s+guide\b", 28), (r"\bcomparison\b|\bcompare\b|\bvs\.?\b", 22), (r"\bbest\b|\btop\s+\d+\b|\bshortlist\b", 18),
    (r"\bwhat\s+to\s+verify\b|\bbefore\s+adoption\b|\bbefore\s+shortlisting\b", 18), (r"\bdemo\s+questions?\b|\bacceptance\s+criteria\b", 16),
    (r"\bconfiguration\b|\bservice\s+model\b|\btraining\b|\bspare\s+parts?\b", 10), (r"\bseries\b|\bplatform\b|\bsystem\b|\bstation\b|\bmachine\b", 9),
    (r"\blaunch(?:es|ed)?\b|\bnew\b|\bannounces?\b|\bunveils?\b|\breleases?\b", 6),
]
INSIGHT = [
    (r"\bhow\s+to\b|\bwhy\b|\bwhat\s+causes\b|\bexplained\b", 20), (r"\btroubleshooting\b|\broot\s+cause\b|\bdiagnostic\b", 20),
    (r"\bprocess\s+control\b|\bcontrol\s+plan\b|\bprocess\s+window\b", 18), (r"\bchecklist\b|\bcriteria\b|\bacceptance\b", 14),
    (r"\bwhere\s+it\s+matters\b|\bcommon\s+mistake\b|\bengineering\s+output\b", 16), (r"\bdefect\b|\byield\b|\bquality\b|\breflow\b|\bstencil\b|\bplacement\b", 8),
]
NEWS = [
    (r"\bappoints?\b|\bnames?\b|\bhired?\b|\bceo\b|\bdirector\b", 24), (r"\bacquires?\b|\bacquisition\b|\bmerger\b|\bpartnership\b|\bagreement\b", 18),
    (r"\bopens?\b|\bexpands?\b|\bfacility\b|\bhub\b", 16), (r"\breports?\b|\braises?\b|\bbook-to-bill\b|\bsales\b|\brevenue\b", 16),
    (r"\baward\b|\bappointed\b|\bjoins?\b", 12),
]
VENDOR = [
    (r"\bvendor\s+profile\b|\bsupplier\s+profile\b|\bcompany\s+profile\b", 35), (r"\babout\s+the\s+(company|vendor|supplier)\b", 20),
    (r"\bdistributor\b|\brepresentative\b|\breseller\b", 10),
]
EQUIPMENT = [
    r"\baoi\b", r"\bspi\b", r"\baxi\b", r"\bx-?ray\b", r"\binspection\b", r"\bpick\s+and\s+place\b", r"\bplacement\b", r"\breflow\b", r"\bwave\s+soldering\b",
    r"\bselective\s+soldering\b", r"\brework\b", r"\bprinter\b", r"\bstencil\b", r"\bfeeder\b", r"\bnozzle\b", r"\bconformal\s+coating\b", r"\btest\s+fixture\b",
    r"\btooling\b",
]
PRODUCT_LIKE = [r"\bseries\b", r"\bplatform\b", r"\bsystem\b", r"\bstation\b", r"\bmachine\b", r"\bmodel\b", r"\btr\d+\b", r"\bmx-?\d+\b", r"\bcv-?\d+\b"]
BUYER = [
    r"\bbest\s+for\b", r"\bwatch\s+for\b", r"\bdecision\s+output\b", r"\bquestions\s+to\s+ask\b", r"\bwhat\s+to\s+verify\b", r"\bbefore\s+adoption\b",
    r"\bconfiguration\b",
]
SECTIONS = ["news", "insight", "review", "vendor"]
ALIASES = {
    "article": "insight", "insights": "insight", "reviews": "review", "buyer guide": "review", "buyer-guide": "review", "guide": "insight", "vendors": "vendor",
    "supplier": "vendor",
}
PATHS = {"news": "/news/", "insight": "/insights/", "review": "/reviews/", "vendor": "/vendors/"}


def normalize_section(value: Column) -> Column:
    """The section a name stands for, or null; paths stand for none."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in {**{s: s for s in SECTIONS}, **ALIASES}.items() for x in pair])
    return F.try_element_at(names, v)


def hits(low: Column, known: Column, patterns: list[tuple[str, int]]) -> Column:
    """struct(pattern, weight) of the patterns that match, in table order; ``known``: the text's words among theirs."""
    each = F.array(*[F.when(terms.matches(low, known, p), F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("weight"))) for p, w in patterns])
    return F.filter(each, lambda h: h.isNotNull())


def _weight(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda total, h: total + h["weight"])


def _hits_of(text: Column, patterns: list[tuple[str, int]]) -> Column:
    return once(terms.known_words(text, [p for p, _ in patterns]), lambda known: hits(text, known, patterns))


def weighted_score(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The weights of the patterns that match the (lower-cased) text, each once."""
    return _weight(_hits_of(text, patterns))


def weighted_hits(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The patterns that match, in table order: the reasons of ``weighted_score``."""
    return _hits_of(text, patterns)["pattern"]


def routed_text(title: Column, body: Column, category: Column | None = None, tags: Column | None = None, brief: Column | None = None) -> Column:
    """What the router reads of an item: title, body, category, tags and the text of its brief."""
    joined = None if tags is None else F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, body, category, joined, brief) if c is not None])


def any_match(text: Column, patterns: list[str]) -> Column:
    return once(terms.known_words(text, patterns), lambda known: terms.matches(text, known, "|".join(patterns)))


def scores(text: Column, review=REVIEW, insight=INSIGHT, news=NEWS, vendor=VENDOR, equipment=EQUIPMENT, product=PRODUCT_LIKE, buyer=BUYER) -> Column:
    """Scores, flags and hits of the lower-cased text, which is split once for all tables; other pattern tables can be given."""
    tables = {"review": review, "insight": insight, "news": news, "vendor": vendor}
    flags = {"equipment": equipment, "product": product, "buyer": buyer}
    every = [*(p for t in tables.values() for p, _ in t), *(p for t in flags.values() for p in t)]

    def scored(low: Column, known: Column) -> Column:
        found = F.struct(*[hits(low, known, t).alias(name) for name, t in tables.items()])
        held = [terms.matches(low, known, "|".join(t)).alias(name) for name, t in flags.items()]
        return once(found, lambda f: F.struct(*[_weight(f[name]).alias(name) for name in tables], *held, *[f[name]["pattern"].alias(f"{name}_hits") for name in ("review", "insight", "news")]))

    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: once(terms.known_words(low, every), lambda known: scored(low, known)))


def decide(scores: Column, explicit: Column, sourced: Column) -> Column:
    """section, section_path, confidence, reason and reasons from ``scores``; the first rule that holds decides. ``explicit`` is a section or null.

    ``reasons``: the reason and, where a score decides, the first three patterns that made it.
    """
    return once(scores, lambda s: _decision(s, explicit, sourced))


def _decision(s: Column, explicit: Column, sourced: Column) -> Column:
    wanted = F.coalesce(explicit, F.lit(""))
    product = s["equipment"] & s["product"]
    because = {"equipment with review marks": "review", "process explainer": "insight", "company event": "news"}
    rules = [
        ((wanted == "vendor") | (s["vendor"] >= 25), "vendor", 0.9, "vendor profile"),
        (wanted == "review", "review", 0.92, "explicit review"),
        (s["buyer"] & s["equipment"], "review", 0.88, "buyer guide on equipment"),
        (product & (s["review"] >= 18), "review", 0.84, "equipment with review marks"),
        ((wanted == "insight") & product & ((s["review"] >= 14) | (s["review"] > s["insight"] + 6)), "review", 0.84, "review overrides insight"),
        (wanted == "insight", "insight", 0.9, "explicit insight"),
        ((s["insight"] >= F.greatest(s["news"], s["review"]) + 5) & (s["insight"] >= 18), "insight", 0.82, "process explainer"),
        ((wanted == "news") & ~(product & (s["review"] >= 24)), "news", 0.86, "explicit news"),
        ((s["news"] > s["review"]) & (s["news"] >= 16), "news", 0.78, "company event"),
        ((s["review"] >= 22) & s["equipment"], "review", 0.78, "equipment review"),
        (F.coalesce(sourced, F.lit(False)), "news", 0.62, "sourced fresh signal"),
    ]

    def reasons(why: str) -> Column:
        of = because.get(why)
        told = F.array(F.lit(why))
        if of is None:
            return told
        first = F.array_join(F.slice(s[f"{of}_hits"], 1, 3), ", ")
        return F.when(F.size(s[f"{of}_hits"]) > 0, F.concat(told, F.array(F.concat(F.lit(f"{of} hits: "), first)))).otherwise(told)

    def decision(section: str, sure: float, why: str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(PATHS[section]).alias("section_path"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"), reasons(why).alias("reasons"))

    out = decision("insight", 0.6, "technical editorial")
    for holds, section, sure, why in reversed(rules):
        out = F.when(holds, decision(section, sure, why)).otherwise(out)
    return out
