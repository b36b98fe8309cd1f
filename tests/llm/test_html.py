"""Minimum cut against enumeration; extraction on hand-made pages."""

import itertools
import random

from tapeloom.llm import htmltext


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(*sorted(rng.sample(range(n), 2)), rng.randint(0, 6)) for _ in range(rng.randint(0, 12))] if n > 1 else []

        def cost(keep):
            return sum(abs(s) for s, k in zip(scores, keep, strict=True) if s and (s > 0) != k) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023

        assert cost(htmltext.minimum_cut(scores, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


LONG = "This sentence belongs to the article and says enough to be taken for prose, does it not?"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>{LONG}</p>";</script></head><body>
<header class="site-header"><h1>The Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">{LONG}</a></ul></nav>
<div class="cookie-notice"><p>{LONG} We use cookies.</p></div><div class="ad">{LONG}</div>
<article><h1>Title &amp; more</h1><p>First <b>bold<br>new&nbsp;line</b> a&lt;b &copy {LONG}<p>Second. {LONG}</p><div class="ad"><p>{LONG} Buy!</p></div>
<form><label>Mail</label><input><button>Go</button></form><ul><li>one item of a list<li>two</ul><p hidden>{LONG}</p><p>tiny</p></article>
<section id="comments"><h2>Comments</h2><p>{LONG} I agree.</p><p>{LONG} Me too.</p></section>
<aside><p>{LONG} Related.</p></aside><footer>&copy; 2024 {LONG}</footer></body></html>"""
WANT = f"Title & more\n\nFirst bold new line a<b © {LONG}\n\nSecond. {LONG}\n\none item of a list\n\ntwo\n\ntiny"


def test_page():
    assert htmltext.main_text(PAGE)[0] == WANT
    for cut in range(0, len(PAGE), 7):
        htmltext.main_text(PAGE[:cut])
    plain = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div class=menu><a href=x>A</a> <a href=y title=it's>B</a></div>"
    assert htmltext.main_text(plain)[0] == f"{LONG}\n\n{LONG}"
    assert htmltext.main_text("<nav><a>x</a></nav>")[0] == "" and htmltext.main_text("")[0] == "" and htmltext.main_text("<")[0] in ("", "<")
    many = "<article>" + f"<p>{LONG}" * 3000 + "</article>"
    assert htmltext.main_text(many)[0].count("\n\n") == 2999


def test_operator(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (None, "w", "<p>" + LONG)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    rows = htmltext.extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (3, "v", "", 0), (1, "u", WANT, len(WANT)), (None, "w", LONG, len(LONG))]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_names_of_wrappers():
    two = f"{LONG}\n\n{LONG}"
    body = f"<p>{LONG}<p>{LONG}"
    for page in (
        f"<div class='content has-sidebar'>{body}</div>",
        f"<div class='layout layout--with-sidebar no-comments'>{body}</div>",
        f"<article class='post-12 post tag-news'>{body}</article>",
        f"<div class='wrap sidebar-right'><article>{body}</article><div class=sidebar>{LONG}</div></div>",
        f"<div id=widget-page><main>{body}</main></div>",
        f"<article>{body}<section id=comments><article class=comment-body>{LONG}</article></section></article><aside><article>{LONG}</article></aside>",
    ):
        assert htmltext.main_text(page)[0] == two, page


PARAGRAPHS = "".join(f"<p>The {w} of the story is told here in a long and whole sentence, with more than a few words in it.</p>" for w in ("start", "middle", "end"))


def test_wrappers_of_whole_pages_are_not_boilerplate():
    """Layout wrappers keep their article; a comment thread longer than its article still goes."""
    plain = htmltext.main_text(f"<body><div><h1>Title of it</h1>{PARAGRAPHS}</div></body>")[0]
    assert plain.count("whole sentence") == 3
    for a, b in [
        ('<div class="layout has-sidebar">', "</div>"), ('<form id="aspnetForm" action="x">', "</form>"), ('<div class="post no-comments">', "</div>"),
        ('<article class="post tags-news">', "</article>"), ('<article class="page-with-search">', "</article>"), ('<div class="sidebar-right">', "</div>"),
    ]:
        page = f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{a}<h1>Title of it</h1>{PARAGRAPHS}{b}<footer>© 2020 Firm. All rights reserved.</footer></body>"
        assert htmltext.main_text(page)[0].count("whole sentence") == 3 and "Home" not in htmltext.main_text(page)[0], a
    thread = f"<body><article><h1>Title of it</h1>{PARAGRAPHS}</article><section class='comments'><h3>Comments</h3>{'<p>I say this and that about the thing, and I say it again, at length.</p>' * 30}</section></body>"
    assert htmltext.main_text(thread)[0].count("whole sentence") == 3 and "I say" not in htmltext.main_text(thread)[0]
    search = f"<body><form><label>Search</label><input><button>Go</button></form><h1>Title of it</h1>{PARAGRAPHS}</body>"
    assert "Search" not in htmltext.main_text(search)[0] and "Go" not in htmltext.main_text(search)[0].split()


def said(i, kind="div", by="p"):
    return f"<{kind} class=c{i % 2 * 0}><{by}>Reader{i} said 3 days ago</{by}><p>I say this and that about the whole thing, and I say it again, at some length {i}.</p></{kind}>"


MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More of it</a></li></ul></nav>"
END = "<footer>© 2020 Firm. All rights reserved.</footer>"
# (before the article, after it, between the article and the page's end): what stands around three paragraphs
SHAPES = [
    ("<div>", "</div>", ""),
    ('<article class="post tags-news">', "</article>", ""),
    ('<article class="post category-social">', "</article>", ""),
    ('<form id="aspnetForm"><h2>Title of it</h2>', "</form>", ""),
    ('<div class="ads-layout"><h2>Title of it</h2>', "</div>", ""),
    ('<div id="page" class="site-menu-open">', "</div>", ""),
    ('<div class="widget"><div class="widget-content">', "</div></div>", ""),
    ('<div class="shared-search sidebar">', "</div>", "<div class=sidebar><p>Other posts that you may like to read on this site of ours, all of them.</p></div>"),
    ("<article>", "</article>", '<section class="discussion"><h3>3 thoughts on this</h3>' + "".join(map(said, range(3))) + "</section>"),
    ("<article>", "</article>", "<section><h3>3 thoughts on &ldquo;Title&rdquo;</h3>" + "".join(map(said, range(3))) + "</section>"),
    ("<article>", "</article>", "<div id=x9><h4>Discussion</h4>" + "".join(map(said, range(3))) + "</div>"),
    ("<article>", "</article>", "<ol>" + "".join(said(i, "li", "span") for i in range(4)).replace("</span>", "</span><br>").replace("<span>", "<div>").replace("</span><br>", "</div>") + "</ol>"),
    ("<div class=main>", "<h3>Leave a reply</h3><p>Your address will not be shown to anyone, and we ask all to stay polite here.</p></div>", ""),
    ("<article>", "</article>", "<section>" + "".join(map(said, range(12))) + "</section>"),
    ("<main>", "<p>We use cookies on this site to make it better for you, and you agree to that by reading on.</p></main>", ""),
    ("<article>", "</article>", '<div class="cookie-bar"><p>' + "This site stores cookies for statistics and for advertising, as told in our policy. " * 20 + "</p></div>"),
    ('<div role="main" class="has-sidebar no-comments">', "</div>", '<div class="related"><p>Read also the other story of the same writer that came out last week.</p></div>'),
    ("<table><tr><td class=nav><a href=a>One</a><a href=b>Two</a></td><td>", "</td></tr></table>", ""),
]


def test_labelled_pages():
    """Precision and recall over words of the main text, and each shape by itself."""
    right = found = wanted = 0
    body = [f"The {w} of the story is told here in a long and whole sentence, with more than a few words in it." for w in ("start", "middle", "end")]
    for before, after, more in SHAPES:
        page = f"<html><body>{MENU}{before}{PARAGRAPHS}{after}{more}{END}</body></html>"
        got = htmltext.main_text(page)[0].split("\n\n")
        assert set(body) <= set(got), (before, after, more, got)
        rest = [b for b in got if b not in body and b != "Title of it"]
        right += sum(len(b.split()) for b in body)
        wanted += sum(len(b.split()) for b in body)
        found += sum(len(b.split()) for b in [*body, *rest])
        assert not rest, (before, after, more, rest)
    assert right / found >= 0.95 and right / wanted >= 0.95


def test_dialogue_and_lists_stay():
    tale = "<article>" + "".join(f"<p>“I don't know about {i},” he said.</p>" for i in range(12)) + "</article>"
    assert htmltext.main_text(tale)[0].count("he said") == 12
    talk = f"<article>{PARAGRAPHS}<h2>Discussion</h2>{PARAGRAPHS}</article>"
    assert htmltext.main_text(talk)[0].count("whole sentence") == 6
    about = f"<article>{PARAGRAPHS}<p>Browsers keep cookies in a file, which is a small text about what one did.</p></article>"
    assert "Browsers keep" in htmltext.main_text(about)[0]


def test_deep_and_broken_pages_take_seconds():
    import time

    for page in ("<div>" * 100_000 + PARAGRAPHS, "<div><p>x y" * 50_000, "<div>" * 50_000 + "</p></i></span>" * 50_000, "<b>" * 50_000 + "<i>word</i> " * 50_000, "<ul><li>" * 50_000 + "<li>x" * 50_000):
        began = time.time()
        htmltext.main_text(page)
        assert time.time() - began < 15
