"""Pages as flat trees: one array for each property of a page's elements, in document order.

A page is parsed once; everything else is array expressions. Element 0 is the document. The descendants of
element i are i + 1 to ``last[i]``, its strings are ``begin[i]`` to ``end[i]`` (exclusive) of ``texts``, the page's trimmed
strings that aren't empty; those of scripts, styles and templates are left out. An end tag closes the innermost open element of its
name with all that is open inside, and nothing if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TREE = "struct<tag:array<string>,classes:array<string>,href:array<string>,parent:array<int>,last:array<int>,begin:array<int>,end:array<int>,texts:array<string>>"
# Elements without content, and those whose strings are no text.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = frozenset(["script", "style", "template", "rt", "rp"])


class _Flat(HTMLParser):
    """Gathers the arrays while a page is read."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.classes, self.href, self.parent = [""], [""], [None], [0]
        self.last, self.begin, self.end, self.texts = [0], [0], [0], []
        self.open, self.held = [0], []

    def flush(self) -> None:
        text = "".join(self.held).strip()
        if text and self.tag[self.open[-1]] not in SILENT:
            self.texts.append(text)
        self.held.clear()

    def close_to(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.last[i], self.end[i] = len(self.tag) - 1, len(self.texts)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        told = dict(attrs)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.classes.append(" ".join((told.get("class") or "").split()))
        self.href.append(told["href"] or "" if "href" in told else None)
        self.last.append(len(self.tag) - 1)
        self.begin.append(len(self.texts))
        self.end.append(len(self.texts))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        self.held.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def flat(html: str | None) -> tuple:
    """The arrays of a page, as far as it can be read."""
    page = _Flat()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # markup that the parser gives up on: what came before stays
        pass
    page.flush()
    page.close_to(0)
    return page.tag, page.classes, page.href, page.parent, page.last, page.begin, page.end, page.texts


def page_tree(html: Column) -> Column:
    """The flat tree of a page, see above."""

    @F.pandas_udf(TREE)
    def trees(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            yield pd.DataFrame([flat(p) for p in batch], columns=["tag", "classes", "href", "parent", "last", "begin", "end", "texts"])

    return trees(html)


def every(tree: Column) -> Column:
    """The numbers of all elements but the document."""
    return F.filter(F.sequence(F.lit(0), F.size(tree["tag"]) - 1), lambda i: i > 0)


def text_of(tree: Column, i: Column) -> Column:
    """An element's strings, joined by spaces."""
    return F.array_join(F.slice(tree["texts"], tree["begin"][i] + 1, tree["end"][i] - tree["begin"][i]), " ")


def has_class(tree: Column, i: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(tree["classes"][i], " "), F.array(*[F.lit(n) for n in names]))


def first_inside(tree: Column, i: Column, tag: str) -> Column:
    """The first descendant with this tag, or null."""
    inside = F.filter(F.sequence(i, tree["last"][i]), lambda j: (j > i) & (tree["tag"][j] == tag))
    return F.try_element_at(inside, F.lit(1))


def ancestors(tree: Column, i: Column, most: int) -> Column:
    """The elements around i, the closest first, up to ``most``; beyond the document it stands for itself."""
    chain, at = [], i
    for _ in range(most):
        at = tree["parent"][at]
        chain.append(at)
    return F.array_distinct(F.array(*chain))
