import itertools
import random

import pytest

from tarn.llm import extract

WORDS = "the river ran over stones and past a mill while people of the town went home in rain or snow".split()


def prose(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(w + (rng.choice(",.") if i % 7 == 6 else "") for i, w in enumerate(words)).capitalize() + "."


def links(rng, n):
    return "".join(f'<li><a href="/{i}?a=1&amp;b=2">{rng.choice(WORDS)}</a></li>' for i in range(n))


def article(rng, long):
    """Markup of an article and its text."""
    title = prose(rng, 6)
    blocks = [(f"<h1>{title}</h1>", title)]
    for _ in range(rng.randint(1, 3)):
        a, b, c = (prose(rng, rng.randint(*long)) for _ in range(3))
        blocks += [
            (f"<p>{a} <b>{b}</b>\n  <a href='/x'>{c}</a></p>", f"{a} {b} {c}"),
            (f"<p>{a}&nbsp;&amp;&#x20AC;&lt;b&gt;<br>{b}", f"{a} &€<b> {b}"),
            (f"<h2>{b[:20].strip()}</h2>", b[:20].strip()),
            ("<ul><li>one<li>two <em>and</em> more</ul>", "one\ntwo and more"),
            (f"<blockquote><p>{c}</p></blockquote>", c),
            ("<table><tr><th>x<th>y<tr><td>1<td>2</table>", "x\ny\n1\n2"),
            ("<pre>if a:\n    b</pre>", "if a: b"),
        ]
    return title, "\n".join(m for m, _ in blocks), "\n".join(t for _, t in blocks)


OUTSIDE = [
    "<nav><ul>{links}</ul></nav>", '<div class="menu main-menu"><ul>{links}</ul></div>', "<header><h1>Site of news</h1><p>{prose}</p></header>",
    "<footer>&copy; All rights, reserved. {prose}</footer>", '<div id="footer"><p>{prose}</p></div>', "<aside><p>{prose}</p></aside>",
    '<div class="sidebar left"><h3>More</h3><p>{prose}</p></div>', '<div class="cookie-notice"><p>We use cookies, as all do. {prose}</p><button>OK</button></div>',
    '<div class="ad">{prose}</div>', '<div id="sponsoredBox">{prose}</div>', "<form action=/s><label>Name</label><input name=q>{prose}<select><option>a<option>b</select></form>",
    "<script>var t = '</p><p>{prose}';</script>", "<style>p > b {{ margin: 0 }}</style>", "<!-- {prose} <p> -->", '<section id="comments"><h2>Comments</h2><article class="comment"><p>{prose}</p></article><p>{prose}</p></section>',
    '<div class="comment-list"><div class="comment">{prose}</div></div>', '<div style="display: none">{prose}</div>', "<div role=navigation>{prose}</div>", "<noscript><p>{prose}</p></noscript>",
]
FRAMES = [
    "<article>{0}</article>", "<main><article>{0}</article></main>", '<div class="wrap"><div id="content">{0}</div></div>', '<div class="page has-sidebar"><div class="post"><div class="post-body">{0}</div></div></div>',
    "<main>{0}</main>", '<table><tr><td class="left">&nbsp;</td><td>{0}</td></tr></table>', "<div><div><div>{0}</div></div></div>", '<article class="post"><div class="entry-content">{0}</div></article>',
]


@pytest.mark.parametrize("frame", range(len(FRAMES)))
def test_planted_articles(frame):
    rng = random.Random(frame)
    for _ in range(60):
        title, body, text = article(rng, (10, 40))
        others = [o.format(links=links(rng, 6), prose=prose(rng, rng.randint(3, 25))) for o in rng.sample(OUTSIDE, 9)]
        page = f"<!DOCTYPE html><html lang=en><head><title>{title} - Site</title><meta charset=utf-8></head><body>{''.join(others[:4])}{FRAMES[frame].format(body)}{''.join(others[4:])}"
        assert extract.main_text(page + rng.choice(["", "</body></html>"])) == text
        inside = others[8] if "<article" in FRAMES[frame] and "header" not in others[8] else ""
        assert extract.main_text(page.replace("<blockquote>", inside + "<blockquote>", 1)) == text


def test_short_articles_beside_longer_others():
    for n, other in itertools.product((1, 3), OUTSIDE[:-1]):
        rng = random.Random(n)
        page = f"<html><body>{other.format(links=links(rng, 5), prose=prose(rng, 60))}<article><h1>{'Word ' * n}</h1></article></body></html>"
        assert extract.main_text(page) == ("Word " * n).strip()


def test_lists_of_links_in_an_article_go_and_prose_with_links_stays():
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 50)
    page = f"<body><div><p>{a}</p><div><ul>{links(rng, 8)}</ul></div><p>See <a href=x>{b[:30].strip()}</a>, {b}</p></div></body>"
    assert extract.main_text(page) == f"{a}\nSee {b[:30].strip()}, {b}"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("   \n", ""), ("plain &amp; text", "plain & text"), ("a < b > c", "a < b > c"), ("<p>", ""), ("<nav>x</nav>", ""), ("<script>x", ""), ("a<!-- b", "a"),
        ("<p>one<p>two", "one\ntwo"), ("<p>a<br/>b<wbr>c<i>d</i></p>", "a bcd"), ("<P TITLE='a>b'>Q</P>", "Q"), ("<p title=it's>Q<p>R's", "Q\nR's"), ("x &am y &notit; &#0; &#150;", "x &am y ¬it; \ufffd –"),
        ("<div>\x85a\u00a0\u3000b\x1c</div>", "a b"), ('<div class="sidebar-layout"><p>Only text, here.</p></div>', "Only text, here."), ("<b>x</i>y</b>", "xy"), ("</div></p>x", "x"), ("<p>\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "\U0001f600"),
        ("<a href='x", ""), ("<![CDATA[x]]>y", "y"), ("<?php x ?>y", "y"), ("<svg><text>no</text></svg><p>yes</p>", "yes"),
    ],
)
def test_odd_pages(html, text):
    assert extract.main_text(html) == text


def test_ratios():
    """The path of short link texts is under the threshold, the path of sentences over it."""
    rng = random.Random(3)
    page = extract.Page("<body>" + "".join(f"<div><p>{prose(rng, 30)}</p></div>" for _ in range(5)) + f"<ul>{links(rng, 10)}</ul></body>", True)
    fused, least = extract.scores(page)
    assert all(f >= least for f in fused[:5]) and all(f < least for f in fused[5:]) and len(set(fused[:5])) == 1


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<p>a. b" * 50_000, "<b></i>" * 50_000 + "x", '<a b="x' * 20_000, "<" * 100_000, "<!-" * 50_000, "&" * 100_000, "<li>" * 50_000 + "x", "<tr><td>" * 30_000 + "x"])
def test_long_pages_take_linear_time(html):
    extract.main_text(html)


def test_table(spark):
    rows = [(1, "u", "<p>é, x.</p>", 5, "old"), (1, "u", "<p>é, x.</p>", 5, "old"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    out = extract.extracted(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "u", "é, x.", 5), (1, "u", "é, x.", 5), (None, None, "", 0)]
    assert extract.extracted(df.where("false")).count() == 0
