import random
import time

import pytest

from gleanwork.llm import html_text

PROSE = "the cat and the dog of the house are in the garden now and they are not out " * 4
TEXT = " ".join(PROSE.split())


def test_cards_in_articles_do_not_veto_the_text():
    card = "<article><h3><a href=/x>Another story of the day</a></h3><p>A teaser of the story that is on the other page, with some words.</p></article>"
    page = f"<body><nav><a href=/>Home</a></nav><div><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div>{card * 3}<footer>f</footer></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head", TEXT, "Short.", TEXT]
    aside = f"<body><article><p>{PROSE}</p></article><aside>{card}</aside></body>"
    assert html_text.main_text(aside) == TEXT


def test_both_passes_inside_and_outside_of_an_article():
    links = "<ul><li><a href=/a>One more story</a></li><li>by us</li><li><a href=/b>And another story</a></li></ul>"
    page = f"<body><h1>Head</h1><article><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>{links}</article><div><p>{PROSE}</p></div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head", TEXT, "Short.", TEXT, TEXT]


def test_article_is_evidence_for_undecided_blocks():
    foreign = "kissa ja koira istuvat puutarhassa eivätkä lähde sieltä minnekään vaikka sataa " * 5
    page = f"<body><p>A line.</p><article><h1>Otsikko</h1><p>{foreign}</p><p>Loppu.</p></article><p>{PROSE[:230]}</p></body>"
    assert html_text.main_text(page).split("\n\n")[:3] == ["Otsikko", " ".join(foreign.split()), "Loppu."]
    teasers = "".join(f"<article><h2>Story {i}</h2><p>What the story is about.</p></article>" for i in range(3))
    assert html_text.main_text(f"<body>{teasers}</body>").count("What the story") == 3


def test_unclosed_elements_keep_the_page():
    body = f"<div><h1>Head</h1><p>{PROSE}</p></div>"
    for start in (
        "<html><head><title>t</title><meta charset=utf-8><body>", "<head><title>t<body>", "<head><title>t</head><body>", "<title>t", "<body><select><option>a", "<body><noscript>",
        "<body><svg-icon></svg-icon>", "<body><select-box>", "<body><textarea rows=2>", "<body><script>var a = '<!--';</script>", "<body><style>a{}</style >", "<!--><body>",
    ):
        assert html_text.main_text(start + body).endswith(f"Head\n\n{TEXT}"), start
        assert f"Head\n\n{TEXT}" in html_text.main_text(start + body + "<select><option>b</select><noscript>c</noscript>"), start
    gone = f"<head><title>a <b> title</title><style>{PROSE}</style></head><body><!-- <script> -->{body}<svg><svg></svg><text>{PROSE}</text></svg><noscript><p>{PROSE}</p></noscript><script>'<p>{PROSE}'"
    assert html_text.main_text(gone) == f"Head\n\n{TEXT}"


def test_class_words_lower_but_do_not_outlaw():
    parts = f"<p>{PROSE}</p><p>Short.</p><p>{PROSE}</p>"
    want = [TEXT, "Short.", TEXT]
    for page in (
        f"<body class='has-sidebar'>{parts}", f"<html id=search><body class=social><main class='with-comments'>{parts}</main>", f"<article class='post has-sidebar'>{parts}</article>",
        f"<div class='page nav-open'>{parts}</div><p>&copy; 2024</p>", f"<div class=wrap><div class='has-sidebar'>{parts}<div class=related><p>{PROSE}</p></div></div></div>",
    ):
        assert html_text.main_text(page).split("\n\n") == want, page
    notices = f"<div class=ad><p>{PROSE}</p></div>{parts}<div class=comments><p>{PROSE}</p><p>Thanks.</p><p>{PROSE}</p></div>"
    assert html_text.main_text(f"<body>{notices}</body>").split("\n\n") == want
    quoted = f"<body><p>{PROSE}</p><div class='social-proof'><p>{PROSE}</p></div><p>{PROSE}</p></body>"
    assert html_text.main_text(quoted).split("\n\n") == [TEXT] * 3


def test_lost_text_cases():
    russian = "Кошка и собака сидят в саду и никуда оттуда не уходят, хотя дождь идёт уже третий день подряд. " * 4
    for page, want in (
        (f"<html><head><meta charset=utf-8><p>{PROSE}</p>", TEXT),
        (f"<body><script>var a=\"<!--\";</script><p>{PROSE}</p>", TEXT),
        (f"<body class=\"right-sidebar\"><p>{PROSE}</p>", TEXT),
        (f"<article class=\"post has-related tags\"><p>{PROSE}</p></article>", TEXT),
        (f"<div id=\"search-results-side\"><p>{PROSE}</p></div>", TEXT),
        (f"<body><div><a href=/>Home</a></div><h1>Заголовок</h1><p>{russian}</p><p>{russian}</p><div><a href=/x>Ещё</a></div>", "Заголовок\n\n" + "\n\n".join([" ".join(russian.split())] * 2)),
        (f"<article><div class=\"article-header\"><h1>Head</h1></div><p>{PROSE}</p></article>", f"Head\n\n{TEXT}"),
        (f"<article><div class=\"entry-header\"><h1>Head</h1></div><p>{PROSE}</p><div class=\"post-comments\"><p>Nice.</p></div></article>", f"Head\n\n{TEXT}"),
        (f"<article><select><option>a</option><p>{PROSE}</p></article>", TEXT),
        (f"<p title='a > b'>{PROSE}</p><p x=\">{PROSE}</p>", f"{TEXT}\n\n{TEXT}"),
    ):
        assert html_text.main_text(page).endswith(want), page[:80]


@pytest.mark.parametrize("part", ["<svg <", "<", "<a b='", "<a b='>", "<title ", "<title>", "<head>", "<!--", "<script>", "<style ", "<![CDATA[", "<select>", "<a \"", "<a x=\"' y='\"", "<a<", "&#x", "<div class='a ", "</div>", "<a = "])
def test_malformed_pages_take_linear_time(part):
    took = []
    for size in (1 << 17, 1 << 20):
        began = time.process_time()
        html_text.main_text(part * (size // len(part)) + ">")
        took.append(time.process_time() - began)
    assert took[1] < max(1.0, 24 * took[0]), took


def labelled_page(draw, n):
    """A page in one of many layouts, with the blocks of its main text and those of its clutter."""
    words = PROSE.split()
    text = lambda k: " ".join(draw.choices(words, k=k)).capitalize() + "."
    main, clutter = [f"Title {n} of the story"], []
    for i in range(draw.randint(3, 7)):
        main.append(f"{text(draw.choice([9, 40, 70, 120]))} m{n}x{i}")
    inner = [f"<h1>{main[0]}</h1>"]
    for i, p in enumerate(main[1:]):
        inner.append(draw.choice([f"<p>{p}</p>", f"<p class=lead>{p}</p>", f"<div>{p}</div>"]))

    def junk(k, wrap):
        clutter.append(f"{text(k)} c{n}x{len(clutter)}")
        return wrap.format(clutter[-1])

    if draw.random() < 0.4:
        inner.insert(2, junk(30, "<aside><p>{}</p></aside>"))
    if draw.random() < 0.4:
        inner.append(junk(40, "<div class='comments'><p>{}</p></div>"))
    open_, close = draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-body'>", "</div>"), ("<div id=content>", "</div>"), ("<table><tr><td>", "</td></tr></table>")])
    head = [junk(3, "<nav><ul><li><a href=/>{}</a></li></ul></nav>"), junk(12, "<header><div>{}</div></header>"), junk(35, "<div class='cookie-banner'><p>{}</p></div>")]
    tail = [junk(5, "<div class='related'><a href=/r>{}</a></div>"), junk(25, "<form><p>{}</p></form>"), junk(14, "<footer><p>{}</p></footer>")]
    return f"<html><head><title>t</title></head><body>{''.join(head)}{open_}{''.join(inner)}{close}{''.join(tail)}</body></html>", main, clutter


def test_precision_and_recall_of_blocks():
    draw, hit, kept, wanted = random.Random(12), 0, 0, 0
    for n in range(400):
        page, main, _ = labelled_page(draw, n)
        got = html_text.main_text(page).split("\n\n")
        hit += len(set(got) & set(main))
        kept += len(got)
        wanted += len(main)
    assert hit / kept >= 0.97 and hit / wanted >= 0.97, (hit / kept, hit / wanted)


LONG_TEXT = "The committee said on Monday that the plan for the new bridge would be ready in the spring and that all of the people who live by the river have been told about the work that is to be done there before the end of the year."
READER = "I think that this is the best thing that I have seen in a long time and I would like to say that all of the people here should be able to see it as well because it is so good and it was so easy to do for me and for my friends."


@pytest.mark.parametrize("name", ["advert", "cookie-notice", "newsletter-signup", "sidebar", "comments", "user-comments", "share-box", "ad slot", "comment-body"])
def test_names_without_doubt_beat_density(name):
    block = f"<div class='{name}'><p>{READER}</p></div>"
    for page, n in (
        (f"<article><h1>Head</h1><p>{LONG_TEXT}</p>{block}<p>{LONG_TEXT}</p></article>", 2), (f"<main><h1>Head</h1><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p>{block}</main>", 2),
        (f"<div><h1>Head</h1><p>{LONG_TEXT}</p>{block}<p>{LONG_TEXT}</p></div>", 2), (f"<article><h1>Head</h1><p>{LONG_TEXT}</p>{block * 8}</article>", 1),
    ):
        assert html_text.main_text(page).split("\n\n") == ["Head", *[LONG_TEXT] * n], page
    whole = html_text.main_text(f"<div class='{name}'><article><h1>Head</h1><p>{LONG_TEXT}</p><p>{READER}</p></article></div>")
    assert whole.split("\n\n") == ["Head", LONG_TEXT, READER]


def test_what_a_heading_of_comments_announces_goes():
    article = f"<h1>Head</h1><p>{LONG_TEXT}</p>"
    for page in (
        f"<article>{article}<h3>3 Comments</h3><ul><li>{READER}</li><li>{READER}</li></ul></article>", f"<div>{article}</div><section><h3>Comments (12)</h3><div>{READER}</div></section>",
        f"<article>{article}<h2>Leave a comment</h2><p>{READER}</p></article>", f"<div>{article}<h3>2 Replies</h3><div><p>{READER}</p></div></div>",
    ):
        assert html_text.main_text(page).split("\n\n") == ["Head", LONG_TEXT], page
    goes_on = html_text.main_text(f"<article>{article}<h3>Comments</h3><p>{READER}</p><h2>More of it</h2><p>{LONG_TEXT}</p></article>")
    assert goes_on.split("\n\n") == ["Head", LONG_TEXT, "More of it", LONG_TEXT]
    said = html_text.main_text(f"<article>{article}<h2>Discussion of results</h2><p>{LONG_TEXT}</p></article>")
    assert said.count(LONG_TEXT) == 2


@pytest.mark.parametrize("deep", [1, 5, 7, 8, 9, 12, 60])
def test_any_depth_counts_alike(deep):
    page = f"<div><p>{LONG_TEXT}</p>{'<div>' * deep}<p>{LONG_TEXT}</p><p>A short line</p>{'</div>' * deep}<ul><li><a href=x>a link here</a></li><li><a href=x>b link here</a></li></ul></div>"
    assert html_text.main_text(page).split("\n\n") == [LONG_TEXT, LONG_TEXT, "A short line"]


def test_short_paragraphs_of_languages_without_stop_words():
    russian = "Совет города сообщил в понедельник что план нового моста будет готов весной и всем жителям реки уже сообщили об этом."
    chinese = "市议会周一表示新桥的计划将在春季准备就绪所有住在河边的人都已被告知年底之前将在那里进行的工作并且将会有更多的消息"
    menu = "<ul><li><a href=/>首页</a></li><li><a href=/b>新闻</a></li></ul>"
    for title, text in (("Заголовок", russian), ("标题", chinese)):
        got = html_text.main_text(f"<div>{menu}<h1>{title}</h1><p>{text}</p><p>{text}</p><p>{text}</p></div>")
        assert got.split("\n\n") == [title, text, text, text]
