"""Flat page trees and what is read from them, against a plain tree of nodes."""

import datetime as dt
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import dates
from gleanwork.functions import url as U
from gleanwork.sources import listings, tree

LANDED = "feed string, page string, html string"
NOW = dt.datetime(2024, 6, 1)


class Node:
    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent, self.attrs, self.children = tag, parent, dict(attrs), []

    def strings(self):
        for c in self.children:
            if isinstance(c, str):
                if self.tag not in ("script", "style") and c.strip():
                    yield c.strip()
            else:
                yield from c.strings()

    def text(self):
        return " ".join(self.strings())

    def all(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.all()


class Builder(HTMLParser):
    """Nodes by recursion; end tags close the innermost open element of their name, and strings end at any tag or comment."""

    def __init__(self):
        super().__init__()
        self.at, self.cut = Node("", None), False
        self.root = self.at

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.at = node

    def handle_endtag(self, tag):
        node, self.cut = self.at, True
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_comment(self, data):
        self.cut = True

    def handle_data(self, data):
        if not self.cut and self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)
        self.cut = False


def parsed(html):
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def random_page(seed):
    draw, out, open_ = random.Random(seed), [], []
    for i in range(draw.randrange(20, 120)):
        kind = draw.random()
        if kind < 0.35:
            tag = draw.choice(["div", "li", "section", "p", "span", "article"])
            out.append(f"<{tag} class='{draw.choice(['post-title', 'x headline', 'news', ''])}'>")
            open_.append(tag)
        elif kind < 0.6 and open_:
            out.append(f"</{draw.choice(open_) if draw.random() < 0.2 else open_.pop()}>")
        elif kind < 0.75:
            href = f"/news/{draw.randrange(30)}" if draw.random() < 0.9 else ""
            title = f"We launch platform {i} &amp; <b>more</b>"
            link = f"<a class='{draw.choice(['title', 'entry-title', 'other'])}' href='{href}'>{title}</a>"
            out.append(draw.choice([link, f"<h2>{link}</h2>", f"<h3>News <em>of</em> {link}</h3>", "<h4>no link</h4>"]))
        elif kind < 0.85:
            out.append(f" {dt.date(2024, draw.randrange(1, 6), draw.randrange(1, 28))} ")
        else:
            out.append(draw.choice([" words here ", "<br>", "<!-- 2024-01-01 -->", "<script>var x = '2024-02-02';</script>", " many words " * 120]))
    return "".join(out)


def test_arrays_are_the_tree(spark):
    pages = [random_page(i) for i in range(25)] + ["", None, "just text", "<p>un<b>closed", "</p>stray</div>", "<div/><img src=x>after<br/>it", "<![odd[ x ]]><p>y</p>", "<a href>none</a><A HREF='U'>UP</A>"]
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(3)
    t = F.col("tree")
    got = frame.select("id", tree.page_tree(F.col("html")).alias("tree")).select("id", "tree", F.transform(tree.every(t), lambda i: tree.text_of(t, i)).alias("said"), F.transform(tree.every(t), lambda i: tree.first_inside(t, i, "a")).alias("link")).collect()
    assert len(got) == len(pages)
    for r in got:
        if pages[r["id"]] and "<![" in pages[r["id"]] or pages[r["id"]] == "<div/><img src=x>after<br/>it":
            continue
        root, flat = parsed(pages[r["id"]] or ""), r["tree"]
        nodes = [root, *root.all()]
        number = {id(n): i for i, n in enumerate(nodes)}
        assert flat["tag"] == [n.tag for n in nodes]
        assert flat["parent"][1:] == [number[id(n.parent)] for n in nodes[1:]]
        assert flat["last"] == [number[id(n)] + len(list(n.all())) for n in nodes]
        assert r["said"] == [n.text() for n in nodes[1:]]
        assert r["link"] == [next((number[id(d)] for d in n.all() if d.tag == "a"), None) for n in nodes[1:]]
    by = {pages[r["id"]]: r["tree"] for r in got}
    assert by["<div/><img src=x>after<br/>it"]["parent"] == [0, 0, 0, 0] and by["<div/><img src=x>after<br/>it"]["texts"] == ["after", "it"]
    assert by["<a href>none</a><A HREF='U'>UP</A>"]["href"] == [None, "", "U"]


def dated(spark, blocks):
    """parse_any_date of each text."""
    frame = spark.createDataFrame([(b,) for b in blocks] or [("",)], "b string").distinct()
    return {r["b"]: r["at"] for r in frame.select("b", dates.parse_any_date(F.col("b"), F.lit(NOW)).alias("at")).collect()}


def classes(node):
    return (node.attrs.get("class") or "").split()


def plain_listing(root):
    """(title, href, block) of headings, then cards."""
    found = []
    for n in root.all():
        if n.tag in ("h2", "h3", "h4"):
            a = next((d for d in n.all() if d.tag == "a"), None)
            if a is not None and a.attrs.get("href"):
                found.append((a.text(), a.attrs["href"], n.parent.text()))
    for n in root.all():
        up, held = n.parent, False
        while up is not None:
            held, up = held or bool({"post-title", "headline"} & set(classes(up))), up.parent
        if n.tag == "a" and n.attrs.get("href") and ({"title", "entry-title"} & set(classes(n)) or held):
            found.append((n.text(), n.attrs["href"], n.parent.text()))
    return [f for f in found if len(f[0]) >= 8]


def test_listings_against_a_plain_tree(spark):
    pages = [(f"f{i}", f"http://h{i}/p/", random_page(100 + i)) for i in range(12)]
    got = {(r["feed"], r["source"]): r for r in listings.listed_items(spark.createDataFrame(pages, LANDED), F.lit(NOW)).collect()}
    want = {}
    for feed, page, html in pages:
        for title, href, block in plain_listing(parsed(html))[:50]:
            want.setdefault((feed, page[:-3] + href), (title, block))
    at = dated(spark, {b for _, b in want.values()})
    assert set(got) == set(want) and len(want) > 40
    for key, (title, block) in want.items():
        assert got[key]["title"] == title and got[key]["published"] == at[block]
        assert got[key]["snippet"] == block.replace(title, "", 1).strip()[:350]


def test_vendor_links_against_a_plain_tree(spark):
    pages = [(f"f{i}", f"http://h{i}/p/", random_page(300 + i)) for i in range(12)]
    found = []
    for feed, page, html in pages:
        for n in parsed(html).all():
            if n.tag == "a" and n.attrs.get("href") is not None:
                around, up = [], n
                for _ in range(4):
                    up = up.parent if up.parent is not None else up
                    around.append(up.text())
                found.append((feed, page, n.attrs["href"], n.text(), around, n.parent.text()))
    links = spark.createDataFrame([(i, *f[1:4]) for i, f in enumerate(found)], "i int, page string, href string, title string")
    may = {r["i"] for r in links.where(U.is_link_candidate(F.col("page"), F.col("href"), F.col("title"))).collect()}
    at = dated(spark, {b for f in found for b in f[4]})
    want = {}
    for i, (feed, page, href, title, around, parent) in enumerate(found):
        if i in may:
            fitting = [b for b in around if title in b and len(b) <= 1200]
            block = next((b for b in fitting if at[b]), fitting[-1] if fitting else parent)
            want.setdefault((feed, page[:-3] + href), (title, " ".join(block.replace(title, "", 1).split())[:350], at[block] if block in fitting else None))
    got = {(r["feed"], r["source"]): (r["title"], r["snippet"], r["published"]) for r in listings.vendor_items(spark.createDataFrame(pages, LANDED), F.lit(NOW), most=1000).collect()}
    assert len(want) > 30 and got == want


@pytest.mark.parametrize("deep", [1, 3])
def test_the_closest_element_dates_a_link(spark, deep):
    link = "<a href='/news/x'>We launch a platform</a>"
    page = f"<div>2024-01-01 {'<div>' * deep}<ul><li>{link} 2024-03-03</li><li>2024-02-02</li></ul>{'</div>' * deep} 2024-04-04</div>"
    got = listings.vendor_items(spark.createDataFrame([("f", "http://h/", page)], LANDED), F.lit(NOW)).collect()
    assert [(str(r["published"])[:10], r["snippet"]) for r in got] == [("2024-03-03", "2024-03-03")]
    far = f"<div>2024-01-01 <i><i><i><i><i>{link}</i></i></i></i></i></div>"
    assert [r["published"] for r in listings.vendor_items(spark.createDataFrame([("f", "http://h/", far)], LANDED), F.lit(NOW)).collect()] == [None]
