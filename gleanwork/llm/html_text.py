"""HTML extraction by two-pass block rules.

Pages are cut into blocks at block-level tags. The first pass classifies each block by
its length, link density and stop-word density, and by where it stands: inside menus,
footers or forms, as tags and roles tell, it is boilerplate. Class names that tell of
adverts, notices, comments and the like lower a block's label, where they enclose it more
closely than the page's other dense text: names that leave no doubt, such as comments or
newsletter, make it boilerplate unless the page's own text stands in the same element; after others
a dense block needs good neighbours on both sides, and undecided ones go. What follows a heading
such as "3 comments" beside it is no article either. Short blocks and blocks of middling density stay undecided; in the second
pass they inherit the label of their nearest decided neighbours. All pages go through
both passes. A marked article is evidence only: its edges count as good neighbours of the
undecided blocks inside, and blocks without stop words inside stay undecided, as their
language may have none here. It counts for nothing where it holds no dense text and less
text than the dense blocks elsewhere, as teasers do; dense text outside of it is kept. On
pages whose text holds next to none of the known stop words, length and links decide; a character of a
script without spaces counts as two and a half.

Nulls and edge cases: a null or empty page gives an empty text and 0 characters; broken
markup is read as far as it goes (unclosed and unmatched tags, a ``<`` that begins no
tag; an unclosed head or title ends at the next block tag, and only an unclosed comment,
script or style takes the rest of the page, as in browsers); unknown character references stay as they are; pages of any length are read
whole; only page_id, url and html are read, and repeated rows give one row each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags that break blocks, tags whose content is no text, tags and class words of boilerplate.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
UNREAD_TAGS = set("noscript template iframe object svg math canvas textarea select datalist".split())
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header"}
BOILERPLATE_WORDS = set(
    "ad ads adv advert advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar side widget nav navbar navigation menu submenu topbar "
    "breadcrumb breadcrumbs footer foot header masthead comment comments commentlist respond disqus discussion reply replies cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations popular trending "
    "pagination pager tags toolbar copyright legal disclaimer search form skip".split()
)
#: Class words that leave no doubt.
STRONG_WORDS = set(
    "ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo sidebar comment comments commentlist respond disqus reply replies cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe subscription signup share sharing".split()
)
#: Class words that tell of boilerplate unless the same name tells of content, as article-header does.
WEAK_WORDS = set("header head side form notice notices search legal".split())
CONTENT_WORDS = set("article post entry story content body text main".split())
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STOP_WORDS = set(
    "a about after all also an and any are as at be been but by can could for from had has have he her his how i if in into is it its more no not of on one or our out she "
    "so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so und uns "
    "von vor war werden wie wir zu zum zur "
    "al como con del el ella entre era es esta este fue ha hay las lo los muy más no nos o para pero por se sin sobre su sus también tiene todo y ya".split()
)

SHORT, LONG = 70, 200
LINKS, STOPS_LOW, STOPS_HIGH = 0.33, 0.10, 0.20
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[\"'>]")
COMMENT_END = re.compile(r"--!?>")
CODE_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style")}
#: Block tags that end an unclosed head or title.
ENDS_HEAD = BLOCK_TAGS - {"html", "title"} | {"body"}
NAMED = re.compile(r"\b(class|id|role|aria-hidden|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+")
RIGHTS = re.compile(r"©|\(c\) \d{4}|all rights reserved", re.I)
WORD = re.compile(r"\w+")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
REMARKS = re.compile(r"(?:\d+\s+)?(?:user |reader )?(?:comments?|commentaires?|comentarios?|kommentare?)(?:\s*[(\[]?\d+[)\]]?)?:?|\d+\s+(?:replies|responses|reply|response)|leave a (?:comment|reply)", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    region: int  # which marked article it stands in, from 1 on; 0: none
    outcast: bool
    depth: int  # how many elements around it have class words of boilerplate
    strong: int  # how many of them leave no doubt
    level: int  # how many elements it stands in
    low: int  # the fewest that were open between the block before and this one
    holder: int  # the level of the marked article that it stands in

    @cached_property
    def counted(self) -> tuple[int, int]:
        """Its stop words and words."""
        words = WORD.findall(self.text.lower())
        return sum(map(STOP_WORDS.__contains__, words)), len(words)

    @property
    def stops(self) -> float:
        """The share of stop words among its words."""
        return self.counted[0] / max(1, self.counted[1])

    @cached_property
    def length(self) -> float:
        """Its characters; one of a script without spaces stands for about two and a half of others."""
        return len(self.text) + (0 if self.text.isascii() else 1.5 * len(WIDE.findall(self.text)))


def _is_boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in BOILERPLATE_TAGS and not (inside and tag == "header"):
        return True
    return _told_by_attributes(attrs)


def _told_by_attributes(attrs: str) -> bool:
    if "=" in attrs or "hidden" in attrs:
        for name, a, b, c in NAMED.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role" and value in BOILERPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
    return False


def _class_words(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether class words tell of boilerplate, and whether they leave no doubt; those of the page and its article as a whole tell of a part of it or of its layout."""
    if "=" not in attrs or tag in ("html", "body", "main", "article"):
        return False, False
    names = [set(PARTS.findall(name)) for n, a, b, c in NAMED.findall(attrs) if n.lower() in ("class", "id") for name in (a or b or c).lower().split()]
    return any(map(_is_boilerplate_name, names)), any(not n.isdisjoint(STRONG_WORDS) for n in names)


def _is_boilerplate_name(parts: set[str]) -> bool:
    return not parts.isdisjoint(BOILERPLATE_WORDS - WEAK_WORDS if parts & CONTENT_WORDS else BOILERPLATE_WORDS)


def tag_end(page: str, at: int, quoted: bool) -> int:
    """Where the tag whose name ends at ``at`` is closed by >, -1 if it isn't. ``quoted``: a > in a quoted value doesn't count."""
    if not quoted:
        return page.find(">", at)
    while True:
        m = MARK.search(page, at)
        if not m or m.group() == ">":
            return m.start() if m else -1
        if page[max(0, m.start() - 16) : m.start()].rstrip().endswith("="):
            at = page.find(m.group(), m.end()) + 1
            if not at:
                return -1
        else:
            at = m.end()


Item = str | tuple[bool, str, str]


def scan(page: str) -> list[Item]:
    """The page as texts and tags (closing, name, attributes), in one pass: comments and code go.

    Each character is looked at a fixed number of times: a tag that ends in no > outside of quotes
    turns quotes off for the rest, and a page without a further > has no further tags.
    """
    out: list[Item] = []
    at = done = 0
    quoted, last = True, page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            out.append(page[done:])
            return out
        if page.startswith("<!--", at):
            end = COMMENT_END.search(page, at + 4)
            stop = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else end.end() if end else len(page)
            out.append(page[done:at])
            at = done = stop
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find("]]>", at) + 3 if page.startswith("<![CDATA[", at) else page.find(">", at) + 1
            out.append(page[done:at])
            at = done = end if end > 2 or page.startswith("<!>", at) else len(page)
            continue
        m = NAME.match(page, at + 1)
        if not m:
            at += 1
            continue
        end = tag_end(page, m.end(), quoted)
        if end < 0 and quoted:
            quoted = False
            end = page.find(">", m.end())
        if end < 0:
            out.append(page[done:])
            return out
        out.append(page[done:at])
        name, attrs = m.group(2).lower(), page[m.end() : end]
        at = done = end + 1
        if name in CODE_END and not m.group(1) and not attrs.endswith("/"):
            closed = CODE_END[name].search(page, at)
            out.append(" ")
            at = done = closed.end() if closed else len(page)
        else:
            out.append((m.group(1) == "/", name, attrs))


def without_unread(items: list[Item]) -> list[Item]:
    """The items without head and title and without elements that hold no text. Of unclosed elements only the tag goes."""
    opened: dict[str, list[int]] = {}
    cuts: dict[int, int] = {}
    for i, x in enumerate(items):
        if isinstance(x, tuple) and x[1] in UNREAD_TAGS and not x[2].endswith("/"):
            if not x[0]:
                opened.setdefault(x[1], []).append(i)
            elif opened.get(x[1]):
                cuts[opened[x[1]].pop()] = i
    kept: list[Item] = []
    i = 0
    while i < len(items):
        if i in cuts:
            kept.append(" ")
            i = cuts[i]
        else:
            kept.append(items[i])
        i += 1
    out: list[Item] = []
    i = 0
    while i < len(kept):
        x = kept[i]
        if not isinstance(x, tuple) or x[0] or x[1] not in ("head", "title") or x[2].endswith("/"):
            out.append(x)
            i += 1
            continue
        i += 1
        ends = ("title", "head", "body") if x[1] == "title" else ()
        stop = next((j for j in range(i, len(kept)) if isinstance(kept[j], tuple) and _ends_title(kept[j])), len(kept)) if ends else i
        if ends and stop < len(kept) and kept[stop][:2] == (True, "title"):
            i = stop + 1
        else:  # to the head's end, or the first block where that is missing
            i = next((j for j in range(i, len(kept)) if isinstance(kept[j], tuple) and (kept[j][:2] == (True, "head") or kept[j][1] in ENDS_HEAD)), len(kept))
        out.append(" ")
    return out


def _ends_title(x: tuple[bool, str, str]) -> bool:
    return x[1] == "title" or x[1] == "body" and not x[0] or x[:2] == (True, "head")


OUTSIDE = ("", False, 0, 0, 0, 0)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, int, int]] = []  # tag, then what holds from here on: boilerplate, in which article, class words around, strong ones, level
    holders = [0]
    rescued: set[int] = set()  # articles inside of boilerplate
    text: list[str] = []
    linked = anchors = regions = lowest = 0
    tag = "body"

    def close() -> None:
        nonlocal linked, lowest
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            _, bad, region, depth, strong, level = stack[-1] if stack else OUTSIDE
            out.append(Block(joined, min(linked, len(joined)), tag, region, bad, depth, strong, level, min(lowest, level), holders[region]))
            lowest = level
        text.clear()
        linked = 0

    for item in without_unread(scan(page)):
        if isinstance(item, str):
            if item:
                text.append(item)
                linked += len(item.strip()) if anchors else 0
            continue
        closing, name, attrs = item
        if name == "a":
            anchors = 0 if closing else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCK_TAGS:
            close()
            anchors = 0
            tag = name if not closing else (stack[-1][0] if stack else "body")
            if name in ("p", "hr"):
                marked, (worded, sure) = not closing and _is_boilerplate(name, attrs, False), (False, False) if closing else _class_words(name, attrs)
                if not closing and stack and stack[-1][0] == "p":
                    stack.pop()
                if name == "p" and (marked or worded):
                    _, bad, region, depth, strong, level = stack[-1] if stack else OUTSIDE
                    stack.append((name, bad or marked, region, depth + worded, strong + sure, level))
                elif closing and stack and stack[-1][0] == "p":
                    stack.pop()
            elif closing:
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
                tag = stack[-1][0] if stack else "body"
            elif not attrs.endswith("/"):
                if stack and stack[-1][0] == "p":
                    stack.pop()
                _, bad, region, depth, strong, level = stack[-1] if stack else OUTSIDE
                marked = _is_boilerplate(name, attrs, bool(region))
                if name in ("article", "main") and not region and not marked:
                    regions += 1
                    holders.append(level + 1)
                    rescued.update([regions] if bad else [])
                    bad, region = False, regions  # an unclosed menu or header doesn't swallow the article
                worded, sure = _class_words(name, attrs)
                stack.append((name, bad or marked, region, depth + worded, strong + sure, level + 1))
            lowest = min(lowest, stack[-1][5] if stack else 0)
    close()
    for r in rescued:  # they are boilerplate after all where the page has more text elsewhere
        if _mass(b for b in out if b.region == r) <= _mass(b for b in out if b.region not in rescued):
            for b in out:
                b.outcast |= b.region == r
    return out


def _mass(blocks: Iterable[Block]) -> int:
    """Characters that no tag or link speaks against."""
    return sum(len(b.text) for b in blocks if not b.outcast and b.linked <= LINKS * len(b.text))


def first_pass(b: Block, inside: bool = False, foreign: bool = False) -> str:
    """good, bad, or undecided: near (middling) or short. ``foreign``: stop words tell nothing, so length and links decide."""
    if b.outcast or not inside and b.length < LONG and RIGHTS.search(b.text):
        return "bad"
    density = b.linked / len(b.text)
    if density > LINKS:
        return "bad"
    if b.length < SHORT:
        return "bad" if b.linked and not inside else "short"
    stops = b.stops if not foreign else STOPS_HIGH if b.length > LONG else STOPS_LOW
    if stops >= STOPS_HIGH:
        return "good" if b.length > LONG else "near"
    if stops >= STOPS_LOW:
        return "near"
    return "short" if inside else "bad"


def trusted_regions(blocks: list[Block], labels: list[str]) -> set[int]:
    """Marked articles that count as evidence: they hold dense text, or no less text than the dense blocks elsewhere that no more class words enclose."""
    good: dict[int, int] = {}
    for b, x in zip(blocks, labels, strict=True):
        if x == "good":
            good[b.depth] = good.get(b.depth, 0) + len(b.text)
    regions: dict[int, list[Block]] = {}
    dense = {b.region for b, x in zip(blocks, labels, strict=True) if x == "good"}
    for b in blocks:
        if b.region and not b.outcast:
            regions.setdefault(b.region, []).append(b)
    least = {r: min(b.depth for b in held) for r, held in regions.items()}
    return {r for r, held in regions.items() if r in dense or _mass(held) >= sum(n for d, n in good.items() if d <= least[r])}


def lowered(blocks: list[Block], labels: list[str], trusted: set[int]) -> list[str]:
    """Labels after class words: they count where more of them enclose a block than the text with the strongest label does.

    Words that leave no doubt count where some text of the page, a long block's worth, has fewer of them around it.
    """
    among = [(b, x) for b, x in zip(blocks, labels, strict=True) if not trusted or b.region in trusted]
    base = next((min(b.depth for b, x in among if x == label) for label in ("good", "near", "short") if any(x == label for _, x in among)), 0)
    mass: dict[int, float] = {}
    for b, x in among:
        if x in ("good", "near"):
            mass[b.strong] = mass.get(b.strong, 0.0) + b.length
    sure, held = max(mass, default=0), 0.0
    for strong in sorted(mass):
        held += mass[strong]
        if held >= LONG:
            sure = strong
            break
    return ["bad" if b.strong > sure else x if b.depth <= base else "low" if x == "good" else "bad" for b, x in zip(blocks, labels, strict=True)]


def remarks_out(blocks: list[Block]) -> None:
    """A heading that announces comments takes with it what follows beside it, up to the next heading that is no deeper and says something else."""
    level = rank = None
    for b in blocks:
        heading = b.tag in HEADINGS
        told = (heading or b.length < SHORT) and REMARKS.fullmatch(b.text.strip()) is not None
        if level is not None and (b.low < level - 1 or heading and not told and b.level <= level and b.tag <= rank):
            level = rank = None
        if told and heading and level is None:
            level, rank = b.level, b.tag
        if level is not None:
            b.outcast = True


#: A neighbour's label and the level of the closest element that a block shares with it.
Decided = tuple[str, int]


def second_pass(blocks: list[Block], labels: list[str], trusted: set[int]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided neighbours; the page's edges count as bad, those of a trusted article as good inside.

    Menus, asides and the like lie beside the text and are nobody's neighbours. Where the two
    neighbours of a short block differ, the one with which it shares the closer element decides.
    """
    regions = [b.region if b.region in trusted else 0 for b in blocks]

    def one_way(labels: Iterable[str], regions: Iterable[int], blocks: Iterable[Block], lows: Iterable[int]) -> list[Decided]:
        """``lows``: the fewest open elements between each block and the one before it on this way."""
        out, last, shared, at, edge = [], "bad", -1, 0, False
        for x, region, b, low in zip(labels, regions, blocks, lows, strict=True):
            shared = min(shared, low)
            if region and region != at:
                last, shared, edge = "good", b.holder, True
            elif region != at and edge:  # an article's edge is near to nothing outside of it
                shared = -1
            at = region
            out.append((last, shared))
            if x in ("good", "bad") and not b.outcast:
                last, shared, edge = x, b.level, False
        return out

    def neighbours(decided: list[str]) -> list[tuple[Decided, Decided]]:
        lows = [b.low for b in blocks]
        back = one_way(reversed(decided), reversed(regions), reversed(blocks), reversed([*lows[1:], 0][: len(lows)]))
        return list(zip(one_way(decided, regions, blocks, lows), reversed(back), strict=True))

    def nearer(before: Decided, after: Decided) -> str:
        return "bad" if before[0] != after[0] and before[1] == after[1] else before[0] if before[1] >= after[1] else after[0]

    around = neighbours(labels)
    nears = [("good" if "good" in (around[i][0][0], around[i][1][0]) else "bad") if x == "near" else x for i, x in enumerate(labels)]
    if "good" not in nears and not trusted:
        nears = ["good" if x == "near" else y for x, y in zip(labels, nears, strict=True)]
    if "good" not in nears and not trusted:  # a page of short blocks only: its paragraphs and headings are all there is
        return [x == "short" and b.tag in HEADINGS | {"p"} for x, b in zip(nears, blocks, strict=True)]
    out = []
    for b, x, (before, after) in zip(blocks, nears, neighbours(nears), strict=True):
        if x == "short":
            x = "good" if b.tag in HEADINGS and after[0] == "good" else nearer(before, after)
        elif x == "low":
            x = "good" if before[0] == after[0] == "good" else "bad"
        out.append(x == "good")
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    remarks_out(blocks)
    told = [b.counted for b in blocks if b.length >= SHORT and not b.outcast and b.linked <= LINKS * len(b.text)]
    foreign = bool(told) and sum(n for n, _ in told) < STOPS_LOW / 2 * sum(n for _, n in told)
    labels = [first_pass(b, False, foreign) for b in blocks]
    trusted = trusted_regions(blocks, labels)
    labels = [first_pass(b, True, foreign) if b.region in trusted else x for b, x in zip(blocks, labels, strict=True)]
    labels = lowered(blocks, labels, trusted)
    return "\n\n".join(b.text for b, keep in zip(blocks, second_pass(blocks, labels, trusted), strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with their main text in ``text``, for the columns page_id, url and html."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.select("page_id", "url", texts("html").alias("text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
